"""The shell-command job: a table of commands in, a table of classified facts out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.functions import shell as sh
from sessionlens.functions import text as tx
from sessionlens.schema import STREAM

TARGETS = "array<struct<path:string,kind:string>>"


def shell_commands(events: DataFrame) -> DataFrame:
    """The shell calls that carry a command text."""
    return (events.where((F.col("type") == "tool/call") & F.col("command").isNotNull())
            .select(*STREAM, "pos", "seq", "command"))


def classify(commands: DataFrame, text: str = "command") -> DataFrame:
    """C2-C11 for every row; the text column itself is dropped.

    Each stage is its own projection so the surface and the verb are computed once per row.
    """
    kept = [c for c in commands.columns if c != text]
    command = F.col(text)
    mutating = F.col("verb_class") == "MUTATING"
    content = F.col("write_kind").isin(*sh.CONTENT_KINDS)
    return (
        commands
        .withColumn("verb_class", sh.verb_class(command))
        .withColumn("surface", F.when(mutating, sh.shell_surface(command)))
        .withColumn("write_kind", F.when(mutating, sh.write_kind(command, F.col("surface"))))
        .withColumn("targets", F.when(content, sh.target_list(command, F.col("surface")))
                    .otherwise(F.array().cast(TARGETS)))
        .withColumn("referenced", sh.referenced_paths(command))
        .withColumn("excerpt", tx.redact_excerpt(command))
        .select(*kept, "verb_class", "write_kind", "targets", "referenced", "excerpt")
    )


def target_kinds(classified: DataFrame) -> DataFrame:
    """C9 as a map column: written path -> the form that names it."""
    return classified.withColumn("target_kinds", F.map_from_entries("targets"))
