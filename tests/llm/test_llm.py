"""The training-data operators against brute force, and on awkward input."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import textwrap
import zlib
from collections import Counter, defaultdict
from datetime import date

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sessionlens.llm import (
    decontam, licenses, lm, ngram_join, packing, pii, quality, sharding, shared, urllist, warc,
)

public_tokenizers = pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, lang string, _key string, `n` long, token string, _hash int"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [(1, "Some plain words stand here, and more of them follow.\nAnother line ends well.", "en"),
            (2, None, None), (3, "", "en"), (4, " \n\t ", "de"), (5, "one two", "en"),
            (5, "one two", "en"), (6, "ONE TWO", None), (None, "no key at all here, none.", "en"),
            (None, None, None), (7, LONG, "en"), (8, "mail a.b@c.de now +1 (555) 222-3333", "en"),
            (9, "é ü ß 漢字 “quoted” \x0b end", "fr")]
    return spark.createDataFrame([(*r, "x", 7, "t", 1) for r in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_words_of_a_batch_are_the_contracts_words():
    texts = ["Ab cd", None, "", "  x\x0b\x0cY\r\nz ", "no", "edge", LONG, "a" * 200_000 + " B", "b"]
    hashes, bounds = shared.batch_words(pa.array(texts))
    seen = {}
    for k, text in enumerate(texts):
        own = hashes[bounds[k]:bounds[k + 1]].tolist()
        assert len(own) == len(tokens(text))
        for word, value in zip(tokens(text), own, strict=True):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)
    sliced, at = shared.batch_words(pa.array(texts).slice(3, 3))
    assert sliced.tolist() == hashes[bounds[3]:bounds[6]].tolist() and at[0] == 0


# --- sharding ---------------------------------------------------------------------------------

def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_is_the_published_loop_and_grows_into_the_new_shard_only():
    keys = np.random.default_rng(1).integers(0, 1 << 64, 3000, np.uint64)
    for shards in (1, 2, 40):
        assert sharding.jump(keys.copy(), shards).tolist() == [plain_jump(int(k), shards) for k in keys]
    a, b = sharding.jump(keys.copy(), 40), sharding.jump(keys.copy(), 41)
    assert set(b[a != b]) == {40} and abs((a != b).mean() - 1 / 41) < 0.02


def test_shards_of_awkward_rows(spark):
    docs = awkward(spark)
    rows = sharding.assign_shards(docs, 3).collect()
    assert len(rows) == docs.count()
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 3)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    one = {r.doc_id: r for r in rows}
    assert (one[2].size, one[2].text_crc32, one[3].size) == (16, 0, 16)
    assert one[9].text_crc32 == zlib.crc32("é ü ß 漢字 “quoted” \x0b end".encode())
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert sharding.assign_shards(empty(spark), 3).count() == 0


def test_one_key_with_most_rows_is_spread_over_slots(spark):
    docs = spark.range(2000).select(F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id")).alias("doc_id"),
                                    F.lit("x").alias("text")).repartition(6)
    rows = sharding.assign_shards(docs, 4).collect()
    hot = [r.slot for r in rows if r.doc_id == 5]
    assert len(hot) >= 1333 and len(set(hot)) == len(hot)


# --- packing ----------------------------------------------------------------------------------

def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    docs = awkward(spark).repartition(3)
    rows = packing.pack(docs, path, 64, with_ids=True).collect()
    windows, per_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        windows[r.sequence_id].append((r.offset, r.length))
        per_doc[(r.doc_id, r.doc_tokens)].append(r)
    for k, pieces in windows.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 64 or k == max(windows)
    assert sorted(windows) == list(range(len(windows)))
    want = Counter()
    for r in docs.collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[(r.doc_id, len(ids))] += len(ids)
        if r.doc_id not in (5, None):
            pieces = sorted(per_doc[(r.doc_id, len(ids))], key=lambda p: p.start)
            joined = b"".join(bytes(p.ids) for p in pieces)
            assert list(struct.unpack(f"<{len(ids)}I", joined)) == ids
            assert pieces[0].starts_document and pieces[-1].ends_document
    assert want == {k: sum(p.length for p in v) for k, v in per_doc.items()}
    assert packing.pack(empty(spark), path, 64).count() == 0


def test_chunks_give_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), packing.ChunkEncoder(path)
    texts = ["It's WE'LL don't, stop. 123abc ÉCOLE straße İstanbul ŉ ǅ é Å", "<|endoftext|>a b",
             "x<|startoftext|>", "日本 語。 fine... ok?! a.b,c", "tab\x0bfeed\x0c \x1c end nbsp em"]
    for text in texts:
        assert own.encode(text.encode()) == plain.encode(text, add_special_tokens=False).ids


def test_texts_are_encoded_together_and_the_memory_starts_anew(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), packing.ChunkEncoder(path)
    monkeypatch.setattr(packing, "CACHE_CHUNKS", 3)
    rng = np.random.default_rng(7)
    for _ in range(20):
        texts = [" ".join(rng.choice(["The", "the,", "Été!", "ÉTÉ", "don't.", "a1b", "end..."], n))
                 for n in rng.integers(0, 9, 6)]
        ids, sizes = own.closed([None if not t else t.encode() for t in texts])
        want = [[*plain.encode(t, add_special_tokens=False).ids, packing.END_ID] for t in texts]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
    for text in ("y<|EndOfText|>", "10m² ½a ¼ \x1c\x7f\x01 ƁaȺ b_c J\u030c J’s s's's"):
        assert own.encode(text.encode()) == plain.encode(text, add_special_tokens=False).ids
    big = pa.array([b"x" * packing.TOGETHER, None, b"y"])
    assert [len(t) for t in packing.together(big)] == [1, 2]


# --- WARC -------------------------------------------------------------------------------------

def test_warc_round_trip(spark, tmp_path):
    big, tail = "x\r\n\r\ny" * 500, "p" * 1200 + "\r\n"
    rows = [(1, "http://a/1", big), (9, "http://a/9", big), (4, None, big), (2, "u", "small"),
            (3, "u", "small"), (5, "u\r\nInjected: 1", None), (6, "u", ""), (7, "u", tail),
            (None, "u", big), (8, "u", "é" * 700 + "WARC/1.1\r\n\r\n"), (10, "u", "a\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for chunk in (7, 1 << 16):
        got = {r.page_id: r for r in warc.round_trip(
            pages, chunk=chunk, folder=str(tmp_path / f"c{chunk}")).collect()}
        assert len(got) == len(rows)
        for key, _, html in rows:
            body = (html or "").encode()
            assert got[key].payload_bytes == len(body)
            assert got[key].payload_digest == hashlib.sha1(body).hexdigest()
        assert {k: r.refers_to for k, r in got.items() if r.record_type == "revisit"} == {
            1: 9, 4: 9, None: 9}
    chunks = warc.read(spark, str(tmp_path / "c7"), with_data=True).where("record_id = 8").collect()
    assert b"".join(bytes(c.data) for c in sorted(chunks, key=lambda c: c.chunk)) == rows[9][2].encode()
    assert max(len(c.data) for c in chunks) == 7
    one = sorted(chunks, key=lambda c: c.chunk)[2]
    assert one.digest_so_far == hashlib.sha1(rows[9][2].encode()[:21]).hexdigest()
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none, folder=str(tmp_path / "none")).count() == 0


def test_no_record_is_divided_over_files(spark, tmp_path):
    rows = [(k, "u", "short") for k in range(30)] + [(30, "u", "long " * 30_000), (31, "u", "x" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    want = {k: (len(t), hashlib.sha1(t.encode()).hexdigest()) for k, _, t in rows}
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 3)
    try:
        for name, size in (("one", warc.FILE_BYTES), ("many", 30_000)):
            folder = tmp_path / name
            warc.write(pages, str(folder), chunk=7, file_bytes=size)
            got = warc.read(spark, str(folder)).where("is_last").collect()
            assert {r.record_id: (r.bytes_so_far, r.digest_so_far) for r in got} == want
            assert len(got) == len(rows)
            assert (len(list(folder.glob("part-*"))) > 1) == (name == "many")
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_a_damaged_archive_is_noticed():
    records = list(warc.segments(1, "u", memoryview(b"hello world"), hashlib.sha1(b"hello world").hexdigest(),
                                 None, 4, b"2024-01-01T00:00:00Z"))
    raw = b"".join(r + warc.END for r in records)
    assert [x[-2] for x in warc.Reader().feed(raw)][-1] == hashlib.sha1(b"hello world").hexdigest()
    with pytest.raises(ValueError, match="damaged"):
        list(warc.Reader().feed(raw.replace(b"o wo", b"o WO")))
    cut = warc.Reader()
    list(cut.feed(raw[:-10]))
    with pytest.raises(ValueError, match="within"):
        cut.close()


# --- quality ----------------------------------------------------------------------------------

def plain_quality(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = defaultdict(list)
    for i in range(len(found) - 4):
        runs[tuple(found[i:i + 5])].append(i)
    covered = {i + k for at in runs.values() if len(at) > 1 for i in at for k in range(5)}
    return (len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered),
            len(found) < 10 or 100 * len(covered) > 20 * len(found))


def test_quality_counts_and_verdicts(spark):
    prose = "The river runs past old mills and wide fields, slow and brown in spring."
    other = "Quite another tale begins beyond the hills, told by older people now."
    texts = [prose, None, "", "a b c d e a b c d e", "x y " * 30, "a b c d e f a b c d e f g a b c d e",
             f"{prose}\nHome | News | Sport | About\nAll rights reserved.\n\n{other}",
             "\n".join(["Home | News | Sport | Tech | More"] * 5 + [prose]),
             "12 34 56 | 78\n" + prose, f"{prose}\n{prose}\n", LONG, "log in\n" + prose,
             "# $ % & | < > * word " * 2]
    docs = spark.createDataFrame([(k, t, "z", 1) for k, t in enumerate(texts)],
                                 "doc_id long, text string, _words string, kept int")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for k, text in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                r.base_failed) == plain_quality(text), (k, text)
    assert [k for k in got if got[k].kept] and got[0].kept and got[6].kept and not got[7].kept
    assert got[6].clean_text == f"{prose}\n\n{other}"
    kept = quality.cleaned(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k in got if got[k].kept}
    assert quality.judge(empty(spark)).count() == 0 and quality.cleaned(empty(spark)).count() == 0


# --- licenses ---------------------------------------------------------------------------------

def test_license_rules(spark):
    names = {v: k for k, v in licenses.SENTENCES.items()}
    say = lambda *ids: "\n".join(names[i].capitalize() + "." for i in ids)
    cases = {
        1: (say("mit-grant", "mit-notice", "mit-warranty"), "MIT"),
        2: (say("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), "BSD-3-Clause"),
        3: (say("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
        4: (say("bsd-source", "bsd-grant"), ""),
        5: ("Prose. Licensed under CC BY-NC 4.0. More; all rights reserved", "CC-BY-NC-4.0"),
        6: ("Licensed under the Apache License, Version 2.0.\nAll rights reserved.", "Apache-2.0,Proprietary"),
        7: (None, ""), 8: ("", ""), 9: ("a license, some day", ""),
    }
    docs = spark.createDataFrame([(k, t, "q") for k, (t, _) in cases.items()],
                                 "doc_id long, text string, _ids string")
    got = {r.doc_id: r for r in licenses.recognise(docs).collect()}
    assert {k: r.licenses for k, r in got.items()} == {k: w for k, (_, w) in cases.items()}
    assert got[4].n_unmatched == 2 and got[6].n_sentences == 2
    assert all(re.search(licenses.HINTS, s) for s in licenses.SENTENCES)
    assert licenses.recognise(empty(spark)).count() == 0


def test_wrapped_license_texts(spark):
    grant = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
             "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
             "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
             "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
             "subject to the following conditions:")
    mit = [grant, "The above copyright notice and this permission notice shall be included in all copies or "
           "substantial portions of the Software.",
           "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
           "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
           "EVENT SHALL THE AUTHORS BE LIABLE."]
    bsd = ["Copyright (c) 2020, Someone. All rights reserved.",
           "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
           "that the following conditions are met:",
           "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
           "following disclaimer.",
           "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
           "the following disclaimer in the documentation and/or other materials provided with the distribution.",
           "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
           "promote products derived from this software without specific prior written permission."]
    apache = ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
              "compliance with the License. You may obtain a copy of the License at",
              "    http://www.apache.org/licenses/LICENSE-2.0",
              "Unless required by applicable law or agreed to in writing, software distributed under the License is "
              "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
              "implied. See the License."]
    gpl = ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
           "Public License as published by the Free Software Foundation; either version {} of the License, or (at "
           "your option) any later version."]
    texts = {"MIT": mit, "BSD-3-Clause,Proprietary": bsd, "BSD-2-Clause,Proprietary": bsd[:4], "Apache-2.0": apache,
             "GPL-3.0-or-later": [gpl[0].format(3)], "GPL-2.0-or-later": [gpl[0].format(2)]}
    wrap = lambda parts, width, start, end: (end + start.rstrip() + end).join(
        end.join(start + x for x in textwrap.wrap(p, width)) for p in parts)
    cases = [(wrap(parts, width, start, end), want) for want, parts in texts.items() for width in (30, 60, 72, 78)
             for start in ("", "# ", " * ") for end in ("\n", "\r\n", "\r")]
    cases += [("All  rights\treserved.", "Proprietary"), ("All rights\nreserved", "Proprietary"),
              ("All rights\n\nreserved", ""), ("All rights\r\n \t\r\nreserved", ""), ("All rights. reserved", ""),
              ("Mostly all rights reserved", ""), ("This work is dedicated to the public-domain.", "Public-Domain"),
              ("Released under\nthe MIT\nlicense; see below", "MIT"), ("H All S rights reserved", "")]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.recognise(docs).collect()}
    for k, (text, want) in enumerate(cases):
        assert got[k].licenses == want, text
    whole = [got[k] for k, (_, want) in enumerate(cases) if want == "Apache-2.0"]
    assert {r.sentence_ids for r in whole} == {"apache-ref,apache-comply,apache-copy,apache-warranty"}
    assert {r.n_unmatched for r in whole} == {0}



# --- URL lists --------------------------------------------------------------------------------

def test_url_lists(spark):
    day = lambda n: date(2024, 1, n)
    entries = spark.createDataFrame(
        [("bad.example", "block", "add", day(3)), ("bad.example", "block", "add", day(4)),
         ("bad.example", "block", "remove", day(6)), ("bad.example", "block", "add", day(9)),
         ("ok.bad.example", "allow", "add", day(4)), ("both.example", "allow", "add", day(1)),
         ("both.example", "block", "add", day(1)), ("tie.example", "block", "add", day(2)),
         ("tie.example", "block", "remove", day(2)), (None, "block", "add", day(1)),
         ("void.example", "block", "remove", day(1)), ("odd.example", "block", "keep", day(1))],
        "name string, list string, action string, day date")
    spans = {(r.name, r.list, r.valid_from.day, r.valid_to.isoformat())
             for r in urllist.intervals(entries).collect()}
    assert spans == {("bad.example", "block", 3, "2024-01-06"), ("bad.example", "block", 9, "9999-12-31"),
                     ("ok.bad.example", "allow", 4, "9999-12-31"), ("both.example", "allow", 1, "9999-12-31"),
                     ("both.example", "block", 1, "9999-12-31")}
    asked = [("http://bad.example/x", 2, "none"), ("http://bad.example/x", 3, "block"),
             ("http://BAD.example:80/x", 5, "block"), ("http://bad.example", 6, "none"),
             ("https://u@a.bad.example?q", 9, "block"), ("http://ok.bad.example/", 9, "allow"),
             ("http://x.ok.bad.example/", 3, "block"), ("http://notbad.example/", 9, "none"),
             ("http://both.example/", 5, "allow"), ("http://tie.example", 5, "none"),
             (None, 5, "none"), ("nonsense", 5, "none"), ("http://bad.example/x", 3, "block")]
    captures = spark.createDataFrame([(k, u, day(d), "c") for k, (u, d, _) in enumerate(asked)],
                                     "page_id long, url string, fetched date, name string")
    got = {r.page_id: r.verdict for r in urllist.judge(captures, entries).collect()}
    assert got == {k: w for k, (_, _, w) in enumerate(asked)}
    assert urllist.judge(captures, entries.limit(0)).where("verdict <> 'none'").count() == 0
    assert urllist.judge(captures.limit(0), entries).count() == 0


# --- personal data ----------------------------------------------------------------------------

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    found = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 16 <= len(digits) <= 19 and pii.luhn(digits),
                    "phone": 8 <= len(digits) <= 15}[kind]
            found += [f"{kind}:{m.start()}:{m.end()}"] * good
    return ",".join(found)


def test_base_spans_equal_the_plain_patterns():
    rng = np.random.default_rng(3)
    letters = list("ab.@@-_%+1234 ()0259\né")
    texts = ["".join(rng.choice(letters, 60)) for _ in range(3000)]
    texts += ["x@@a.b@c.d", "@a.b@c.d", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.4", "4111 1111-1111 1111",
              "+1 (555) 222-3333 x", "", "a@b", "9" * 3000, "a" * 3000 + "@"]
    for text in texts:
        assert pii.listed(pii.base_spans(text)) == plain_spans(text), text


def bootstrap_docs(spark):
    card = ["4111111111111111", "5500005555555559", "4012888888881881", "340000000000009"]
    rows = [(k, f"Note {chr(97 + k) * 4}. Account holder {card[k % 3]} was told so.", "p") for k in range(6)]
    rows += [(20, "Account holder AC-9981-223 was told later.", "p"),
             (21, "We saw AC-9981-223 twice.", "p"), (22, "Nothing here 12345678 at all.", "p"),
             (23, None, "p"), (24, "", "p"), (25, "mail x.y@z.org é", "p"), (None, "a@b.cd", "p"),
             (25, "mail x.y@z.org é", "p"), (26, "the ABC-12345 and the 99887766 of the day", "p")]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string")


def test_contexts_of_seeds_discover_identifiers(spark):
    docs = bootstrap_docs(spark)
    got = pii.personal_data(docs).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        base = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        if r.doc_id in (20, 21):
            (kind, a, b), = [s.split(":") for s in r.spans.split(",")]
            assert kind == "card" and texts[r.doc_id][int(a):int(b)] == "AC-9981-223"
        else:
            assert r.spans == base
    assert pii.personal_data(empty(spark)).count() == 0
    masked = pii.masked(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    out = {r.doc_id: r.text for r in masked.collect()}
    assert out[20] == "Account holder <CARD> was told later." and out[25] == "mail <EMAIL> é"
    assert out[None] == "<EMAIL>" and out[23] is None and out[22] == texts[22]


def test_personal_data_of_awkward_rows(spark):
    docs = awkward(spark)
    got = pii.personal_data(docs).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: r.spans for r in got if r.spans} == {8: plain_spans("mail a.b@c.de now +1 (555) 222-3333")}
    assert pii.masked(docs).count() == docs.count()


# --- decontamination --------------------------------------------------------------------------

def slow_alignment(item, passage):
    best, rows = 0, [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (2 if a == b else -1), rows[i - 1][j] - 1,
                             rows[i][j - 1] - 1)
            best = max(best, rows[i][j])
    return best


def test_alignment_equals_the_table():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 20))
        a, b = a.astype(np.uint64), b.astype(np.uint64)
        score, i, i_end, j, j_end = decontam.align(a, b)
        assert score == slow_alignment(a, b)
        assert slow_alignment(a[i:i_end], b[j:j_end]) == score


def test_leaks_exact_edited_and_none(spark):
    rng = np.random.default_rng(7)
    vocabulary = [f"term{k}" for k in range(4000)]
    say = lambda n: list(rng.choice(vocabulary, n))
    items = {k: say(30) for k in range(6)}
    edited = [w if i % 6 else "changed" for i, w in enumerate(items[1])]
    fewer = [w for i, w in enumerate(items[2]) if i % 7]
    docs = [(1, say(200) + items[0] + say(100)), (2, say(50) + edited + say(60)), (3, say(10) + fewer),
            (4, say(300)), (5, items[3][:8] + say(100)), (6, items[4]), (6, items[4])]
    rows = [(k, " ".join(w).upper() if k == 1 else ", ".join(w), 1) for k, w in docs]
    rows += [(7, None, 1), (8, "", 1), (None, " ".join(items[5]), 1), (None, "other words", 1), (9, "ab", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [
        (90, None), (91, ""), (92, "ab"), (93, "?!")], "item_id long, text string")
    got = decontam.contaminated(frame, bench).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == {
        (1, 0): 1, (2, 1): 1, (3, 2): 1, (6, 4): 2, (None, 5): 1, (9, 92): 1}
    exact = next(r for r in got if r.doc_id == 1)
    assert (exact.similarity, exact.word_start, exact.word_end) == (1.0, 200, 230)
    clean = decontam.without_contaminated(frame, bench)
    assert clean.columns == frame.columns
    assert Counter(r.doc_id for r in clean.collect()) == {4: 1, 5: 1, 7: 1, 8: 1, None: 1}
    assert decontam.contaminated(frame, bench.limit(0)).count() == 0
    assert decontam.contaminated(frame.limit(0), bench).count() == 0


@pytest.mark.parametrize("copies", [False, True])
def test_edited_copies_equal_aligning_everything(spark, copies):
    rng = np.random.default_rng(11)
    vocabulary = [f"term{k}" for k in range(3000)]
    say = lambda n: list(rng.choice(vocabulary, n))
    items = {k: say(n) for k, n in enumerate([20, 36, 60] * 4)}
    docs = [say(40) + w + say(40) for w in items.values()] if copies else []
    for item in items.values():
        for step in (4, 5, 6, 7):
            for first in range(0, step, 2):
                hit = lambda i: i % step == first  # noqa: B023, E731
                docs.append(say(30) + ["changed" if hit(i) else w for i, w in enumerate(item)] + say(30))
                docs.append(say(9) + [w for i, w in enumerate(item) if not hit(i)])
                docs.append([x for i, w in enumerate(item) for x in ([w, "added"] if hit(i) else [w])])
    hashed = {k: decontam.word_hashes(" ".join(w).encode()) for k, w in items.items()}
    want = {}
    for d, words in enumerate(docs):
        passage = decontam.word_hashes(" ".join(words).encode())
        for k, item in hashed.items():
            score = decontam.align(item, passage)[0]
            if score >= decontam.MATCH * len(item) * decontam.MIN_SIMILARITY:
                want[d, k] = score
    got = decontam.contaminated(
        spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string"),
        spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.score for r in got.collect()} == want
    assert len(want) >= len(docs)


# --- n-gram Jaccard join ----------------------------------------------------------------------

def plain_components(rows, percent=85):
    sets = []
    for key, text in rows:
        w = tokens(text)
        sets.append((key, frozenset(tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (key, _) in enumerate(sets):
        least[root(i)] = min(x for x in (least.get(root(i)), key) if x is not None) if (
            key is not None or least.get(root(i)) is not None) else None
    return Counter((key, len(s), least[root(i)]) for i, (key, s) in enumerate(sets))


def near_copies():
    rng = np.random.default_rng(11)
    vocabulary = [f"v{k}" for k in range(500)]
    say = lambda n: list(rng.choice(vocabulary, n))
    passage, rows = say(60), []
    for k in range(40):  # share a passage and nothing else
        rows.append(say(40) + passage + say(int(rng.integers(20, 90))))
    for _ in range(12):  # groups around an original, edited more and more
        original = say(int(rng.integers(30, 200)))
        for edits in range(int(rng.integers(1, 9))):
            copy = list(original)
            for _ in range(edits):
                copy[int(rng.integers(len(copy)))] = "edit"
            rows.append(copy)
    chain = say(150)  # each near the next only
    for k in range(10):
        rows.append(chain[k * 2:] + say(0) + chain[:0])
    return [(int(k), " ".join(w)) for k, w in zip(rng.permutation(len(rows)), rows, strict=True)]


def test_components_equal_brute_force(spark):
    rows = near_copies() + [(1000, None), (1001, ""), (1002, "a b"), (1003, "A B"), (1004, "a b c d"),
                            (1004, "a b c d"), (None, "a b c d"), (None, "lonely words here now ok")]
    docs = spark.createDataFrame([(k, t, "z", 3) for k, t in rows],
                                 "doc_id long, text string, node string, n int").repartition(5)
    got = ngram_join.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(rows)
    kept = ngram_join.representatives(docs)
    assert kept.columns == docs.columns
    want = Counter()
    for (key, size, least), n in plain_components(rows).items():
        if size == 0:
            want[key] += n
        elif key == least:
            want[key] += 1
    assert Counter(r.doc_id for r in kept.collect()) == want


def test_sketches_lose_no_similar_sets():
    rng = np.random.default_rng(31)
    common = np.packbits(rng.random(1 << ngram_join.BLOOM_BITS) < 0.6)
    dropped = 0
    for trial in range(300):
        size, percent = int(rng.integers(1, 400)), (85, 80)[trial % 2]
        pool = np.unique(rng.integers(0, 1 << 63, 2 * size + 2, np.uint64))
        base, spare = pool[rng.permutation(len(pool))][:size], pool[-1:]
        share = rng.random() * (0.25 if trial % 3 else 1)
        x = np.sort(base[rng.random(size) >= share * rng.random()])
        y = np.unique(np.concatenate([base[rng.random(size) >= share * rng.random()], spare]))
        if not len(x):
            continue
        both = len(np.intersect1d(x, y))
        similar = 100 * both >= percent * (len(x) + len(y) - both)
        last = [ngram_join.last_bits(s, common) for s in (x, y)]
        sketches = [ngram_join.sketch(s, bits, percent) for s, bits in zip((x, y), last, strict=True)]
        may = ngram_join.alike(*sketches, percent)
        first = [s[ngram_join.prefix(s, bits, 1, percent)] for s, bits in zip((x, y), last, strict=True)]
        assert may or not similar
        differ = sum(int(v).bit_count() for v in (ngram_join.parity(x) ^ ngram_join.parity(y)).view(np.uint64))
        assert differ <= len(x) + len(y) - 2 * both
        if similar:
            assert differ <= len(x) + len(y) - 2 * ngram_join.needed(len(x), len(y), percent)[0]
            assert len(np.intersect1d(*first)) >= ngram_join.needed(len(x), len(y), percent)[1]
        dropped += not may
    assert dropped > 30


def test_sets_meet_in_the_first_token_they_share():
    """Whatever else the join drops, similar sets have one common token that it keeps."""
    rng = np.random.default_rng(53)
    similar = 0
    for trial in range(300):
        size, percent = int(rng.integers(1, 300)), (85, 80)[trial % 2]
        base = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
        own = rng.integers(0, 1 << 63, (2, size), np.uint64)
        share = rng.random(2) * 0.1
        x, y = (np.unique(np.where(rng.random(len(base)) < s, o[:len(base)], base))
                for s, o in zip(share, own, strict=True))
        y = y[:max(1, int(len(y) * (0.95 + 0.05 * rng.random())))]
        both = len(np.intersect1d(x, y))
        if 100 * both < percent * (len(x) + len(y) - both):
            continue
        similar += 1
        shared, _ = ngram_join.needed(len(x), len(y), percent)
        p, q = (s[ngram_join.prefix(s, None, 1, percent)].tolist() for s in (x, y))
        kept = [t for t in set(p) & set(q)
                if not {*p[max(0, p.index(t) - 2):p.index(t)]} & {*q[max(0, q.index(t) - 2):q.index(t)]}
                and min(len(x) - p.index(t), len(y) - q.index(t)) >= shared]
        assert kept
    assert similar > 100


def test_join_rows_follow_pairs_and_not_the_tokens_they_share(spark, monkeypatch):
    """Two sets that just fail to link share most of their first tokens; they meet in few of them."""
    rng = np.random.default_rng(47)
    rows, both = [], 0
    for k in range(40):
        base = [f"w{k}-{x}" for x in range(300)]
        copy = list(base)
        for at in range(10, 290, 35):
            copy[at + int(rng.integers(20))] = f"edit{at}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        x, y = ngram_join.shingle_sets(pa.array([r[1] for r in rows[-2:]]), ngram_join.SHINGLE)
        both += len(np.intersect1d(*[s[ngram_join.prefix(s, None, 1, ngram_join.PERCENT)] for s in (x, y)]))
    rows.append((100, rows[7][1] + " more"))
    placed, met, pairs = [], [], ngram_join.cross_pairs

    def counted(mixed, percent):
        placed.append(mixed.count())
        if hasattr(ngram_join, "meetings"):
            met.append(ngram_join.meetings(mixed, percent).count())
        return pairs(mixed, percent)

    monkeypatch.setattr(ngram_join, "cross_pairs", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(rows)
    assert placed[0] < 0.4 * 2 * both
    assert met[0] <= 2 * 41


def test_near_copies_are_tied_to_their_original_before_the_join(spark, monkeypatch):
    rng = np.random.default_rng(41)
    base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    rows = [(400, " ".join(base))]
    for k in range(400):  # two copies of two edits each differ too much from each other
        copy = list(base)
        for at in rng.choice(np.arange(5, 145), 2, replace=False):
            copy[at] = f"edit{k}-{at}"
        rows.append((k, " ".join(copy)))
    left, pairs = [], ngram_join.cross_pairs
    monkeypatch.setattr(ngram_join, "cross_pairs", lambda mixed, percent: left.append(
        mixed.count()) or pairs(mixed, percent))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.component_id for r in ngram_join.near_duplicates(docs).collect()} == {0}
    assert left == [0]


def test_middle_is_what_most_rows_have(spark):
    rng = np.random.default_rng(43)
    words = [rng.integers(-(1 << 63), 1 << 63, (n, ngram_join.PARITY)) for n in (1, 2, 3, 40, 501)]
    words.append(np.full((ngram_join.CROWD * 2 - 1, ngram_join.PARITY), -1))
    rows = [(k, *map(int, row)) for k, group in enumerate(words) for row in group]
    schema = "g int, " + ", ".join(f"{w} long" for w in ngram_join.WORDS)
    got = {r[0]: np.array(r[1:]) for r in ngram_join.middles(
        spark.createDataFrame(rows, schema), ["g"]).collect()}
    for k, group in enumerate(words):
        bits = np.unpackbits(group.view(np.uint8), axis=1)
        want = np.packbits(2 * bits.sum(0, dtype=int) > len(group)).view(np.int64)
        assert (got[k] == want).all()


def test_filter_finds_what_all_slots_hold():
    rng = np.random.default_rng(7)
    bits = np.packbits(rng.random(1 << ngram_join.BLOOM_BITS) < 0.4)
    tokens = rng.integers(0, 1 << 63, 5000, np.uint64)
    plain = np.ones(len(tokens), bool)
    for salt in ngram_join.BLOOM_SALTS:
        at = ngram_join.bloom_slots(tokens, salt)
        plain &= np.unpackbits(bits)[at].astype(bool)
    assert 0 < plain.sum() < len(tokens)
    assert (ngram_join.in_bloom(bits, tokens) == plain).all()
    assert not len(ngram_join.in_bloom(bits, tokens[:0]))


def test_components_of_awkward_rows(spark):
    docs = awkward(spark)
    got = ngram_join.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(
        [(r.doc_id, r.text) for r in docs.collect()])
    assert ngram_join.near_duplicates(empty(spark)).count() == 0
    assert ngram_join.representatives(empty(spark)).count() == 0


def test_contraction_finds_the_components_of_a_long_path(spark):
    node = lambda k: hashlib.md5(str(k).encode()).digest()
    path = [(node(k), node(k + 1)) for k in range(60)]
    edges = spark.createDataFrame(path + [(b"zz", b"zy")], "a binary, b binary")
    labels = defaultdict(set)
    for r in ngram_join.components(edges).collect():
        labels[bytes(r.label)].add(bytes(r.node))
    assert sorted(map(len, labels.values())) == [2, 61]


# --- language model ---------------------------------------------------------------------------

def test_language_model_base_and_gain(spark):
    rng = np.random.default_rng(13)
    tongues = [[f"{a}{k}ing" for k in range(60)] for a in ("th", "qu")]
    rows = []
    for k in range(120):
        words = list(rng.choice(tongues[k % 2], 60, p=np.arange(60, 0, -1) / 1830))
        rows.append((k, " ".join(words + ["Again"] * (5 * (k % 5 == 0)) + [f"only{k}"]), "h"))
    rows += [(500, None, "h"), (501, "", "h"), (502, "THING unseen Zzz", "h"), (None, "thing", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held string").repartition(3)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    got = lm.score(docs, held).collect()
    out = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 1
    counts = Counter(t for k, text, _ in rows if not out(k) for t in [*tokens(text), None])
    total, distinct = sum(counts.values()), len(counts)
    want = {}
    for key, text, _ in rows:
        t = [*tokens(text), None]
        want[key] = (out(key), len(t), sum(counts[x] > 0 for x in t), total,
                     sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in t))
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9)
        assert math.isfinite(r.score) and r.score <= 1e-9
    new = [r for r in got if r.held_out]
    assert sum(r.score for r in new) > sum(r.base_score for r in new)


def test_class_probabilities_add_up(spark):
    weights = np.random.default_rng(2).normal(size=(lm.FEATURES, lm.CLASSES))
    assert np.allclose(np.exp(lm.log_softmax(weights, np.arange(500))).sum(1), 1)


def test_word_probabilities_add_up():
    rng = np.random.default_rng(3)
    n, classes = 700, lm.CLASSES
    total, shape, slot = rng.integers(1, 900, n), rng.integers(0, lm.SHAPES, n), rng.integers(0, lm.OWN, n)
    model = lm.Model(300, 1 + lm.OWN + rng.integers(0, lm.SHARED, lm.SHAPES), rng.integers(0, lm.GROUPS, classes + 1),
                     None, None, rng.uniform(0.1, 0.9, classes), None,
                     rng.normal(size=(lm.HISTORIES, classes)).astype(np.float32),
                     rng.normal(size=(lm.WORD_SLOTS, classes)).astype(np.float32),
                     rng.normal(size=(lm.WORD_SLOTS, lm.CELLS)).astype(np.float32), int(total.sum()), n)
    kind, cell = model.classes(total, shape, slot), lm.cells(shape, slot)
    both = [np.zeros((classes, lm.CELLS)) for _ in range(2)]
    for sums, value in zip(both, (total, 1), strict=True):
        np.add.at(sums, (kind, cell), value)
    model.size, model.words = (sums.sum(1) for sums in both)
    model.mass = both[0] - model.discount[:, None] * both[1]
    assert (model.words[1:] > 0).all()
    texts = np.array([[5, 9, w] for w in range(n)])
    block = lm.Block([], np.zeros(n, bool), np.full(n, 3), texts.ravel(), total, None, shape, slot)
    slots, history = lm.word_features(model, block)[:, 2:3], lm.histories(model, block)[2][2:3]
    outcome = lm.class_chances(model, history, slots)[0]
    known = lm.token_chances(model, block)[2::3].sum()
    assert known + (outcome * model.unknown())[1:].sum() == pytest.approx(1, abs=1e-4)


def test_chances_are_computed_once_for_equal_contexts(monkeypatch):
    rng = np.random.default_rng(47)
    n, classes = 30, lm.CLASSES
    total, shape, slot = rng.integers(0, 900, n), rng.integers(0, lm.SHAPES, n), rng.integers(0, lm.OWN, n)
    model = lm.Model(300, 1 + lm.OWN + rng.integers(0, lm.SHARED, lm.SHAPES), rng.integers(0, lm.GROUPS, classes + 1),
                     np.full(classes, 99.0), np.full(classes, 3), rng.uniform(0.1, 0.9, classes),
                     rng.uniform(1, 50, (classes, lm.CELLS)),
                     rng.normal(size=(lm.HISTORIES, classes)).astype(np.float32),
                     rng.normal(size=(lm.WORD_SLOTS, classes)).astype(np.float32),
                     rng.normal(size=(lm.WORD_SLOTS, lm.CELLS)).astype(np.float32), int(total.sum()), n)
    text = np.append(rng.integers(1, n, 39), 0)
    text[5] = text[4]
    block = lm.Block([], np.zeros(200, bool), np.full(200, 40), np.tile(text, 200).astype("<u4"), total, None,
                     shape, slot)
    kind, same, history = lm.histories(model, block)
    slots, cell, unknown = lm.word_features(model, block), lm.cells(shape, slot)[block.tokens], model.unknown()
    outer, every = lm.class_chances(model, history, slots), np.arange(len(kind))
    inner = lm.cell_chances(model, kind, slots)[every, cell]
    seen = total[block.tokens]
    share = (seen - model.discount[kind]) / model.mass[kind, cell]
    want = (outer[every, kind] * np.where(seen > 0, (1 - unknown[kind]) * share * inner, unknown[kind])
            + np.where(same, outer[:, lm.REPEAT], 0))
    rows, chances = [], lm.chances
    monkeypatch.setattr(lm, "chances", lambda scores, *other: rows.append(len(scores)) or chances(scores, *other))
    assert np.allclose(lm.token_chances(model, block), want, rtol=1e-6)
    assert 0 < sum(rows) <= 80  # 8,000 tokens


def test_language_model_sees_which_words_stand_together(spark):
    rng = np.random.default_rng(29)  # all words of one shape, none frequent: one class
    pairs = [(f"th{a}ing", f"th{a + 400}ing") for a in range(400)]
    say = lambda own: " ".join(w for k in own for w in pairs[k])
    rows = [(k, say(rng.permutation(400)[:60])) for k in range(100)]
    rows += [(1000, say(range(80))),
             (1001, " ".join(w for k in range(80) for w in (pairs[k][0], pairs[(k + 7) % 80][1])))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in lm.score(docs, F.col("doc_id") >= 1000).collect()}
    assert got[1000].base_score == pytest.approx(got[1001].base_score)
    assert got[1000].score > got[1001].score + 1


def test_language_model_of_few_rows(spark):
    assert lm.score(empty(spark), F.lit(False)).count() == 0
    docs = awkward(spark)
    for held in (F.lit(True), F.lit(None).cast("boolean")):
        got = lm.score(docs, held).collect()
        assert len(got) == docs.count() and all(math.isfinite(r.score) for r in got)


# --- pipeline ---------------------------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(17)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    say = lambda n: " ".join(rng.choice(vocabulary, n)).capitalize() + "."
    leak = say(40)
    rows = [(k, "\n".join(say(25) for _ in range(4)), "en", "s", 0) for k in range(12)]
    rows += [(20, rows[3][1], "en", "s", 0), (21, rows[4][1] + " Word.", "en", "s", 0),
             (22, say(60) + " " + leak + " " + say(30), "en", "s", 0),
             (23, rows[5][1][:40] + " " + say(60) + " call +1 (555) 222-3333 now.", "en", "s", 0),
             (24, "spam " * 50, "en", "s", 0), (25, None, "en", "s", 0), (26, "", None, None, None),
             (27, "Home | A | B | C\n" + say(40), "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    docs, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        ids[name] = {r.doc_id for r in docs.collect()}
    assert ids["quality_rules"] == {*range(12), 20, 21, 22, 23, 27}
    assert ids["near_duplicates"] == {*range(12), 22, 23, 27}
    assert ids["decontamination"] == ids["personal_data"] == {*range(12), 23, 27}
    texts = {r.doc_id: r for r in docs.collect()}
    assert "<PHONE>" in texts[23].text and "Home" not in texts[27].text
    assert all(r.n_chars == len(r.text) for r in texts.values())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(texts)
    assert all(r.sequence_id == 0 for r in packed) == (sum(r.length for r in packed) <= 4096)


def test_near_duplicates_of_the_pipeline_equal_brute_force(spark):
    import corpus_pipeline

    rng = np.random.default_rng(23)
    rows, between = [], 0
    for group in range(12):
        first = [f"w{x}" for x in rng.integers(0, 3000, 140)]
        copy = list(first)
        for at in (20, 70, 120)[:2 + group % 2]:
            copy[at] = "edited"
        rows += [(" ".join(first)), (" ".join(copy))]
    rows = [(int(k), t) for k, t in zip(rng.permutation(len(rows)), rows, strict=True)]

    def jaccard(a, b, n):
        a, b = ({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} for w in (a.split(), b.split()))
        return 100 * len(a & b) / len(a | b)

    gone = set()
    for k, a in rows:
        for other, b in rows:
            if k < other and jaccard(a, b, 5) >= 80:
                gone.add(other)
                between += jaccard(a, b, 4) < 85
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted({k for k, _ in rows} - gone)
    assert between
