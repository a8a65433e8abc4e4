"""The corpus operators against brute force on small tables, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import html
import io
import itertools
import re
import textwrap
import time
import wave
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from breakwater.llm import audio, golay, html_cut, language_model, licences, mixing, neighbours, packing, quality, sequences, similar_text, simhash

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def text_of(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


TEXTS = [None, "", " \n\t", "One", text_of(1, 40), text_of(1, 40), text_of(1, 40) + " nu", text_of(2, 3000), "É ß 中文 …", "Released under the MIT License.\nx", text_of(3, 900), "a <|endoftext|> b<|endoftext|><|endoftext|>\n c <|endoftext |>"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i != 4 else None, i) for i, t in enumerate(TEXTS)] + [(None, text_of(4, 30), None, None, None), (3, "One", "en", "s0", 1)]
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, cols).withColumns({c: F.lit("clash") for c in ("score", "key", "fingerprint", "length", "copy", "ids")})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_quality(spark, docs, none):
    d, lab = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(d, lab).toPandas()
    held = got[got.held_out].merge(lab.toPandas().dropna(), on="doc_id")
    assert len(got) == d.count() and got.score.between(0, 1).all() and (held.predicted == held.quality).mean() >= 0.85
    stats = {r.doc_id: np.array(r.stats) for r in quality.vectors(d).collect()}
    marks = {r.doc_id: r.quality for r in lab.collect()}
    x = [np.array([stats[i] for i in marks if marks[i] == k and zlib.crc32(str(i).encode()) % 5]) for k in (0, 1)]
    n, cov = [len(y) for y in x], [np.cov(y.T) for y in x]
    pooled = sum((m - 1) * c for m, c in zip(n, cov, strict=True)) / (sum(n) - 2)
    s = np.sqrt(np.maximum(np.diag(pooled), 1e-12))
    logs = []
    for k in (0, 1):
        c = (0.2 * cov[k] + 0.8 * pooled) / np.outer(s, s)
        c = 0.99 * c + 0.01 * np.trace(c) / len(c) * np.eye(len(c))
        z = np.array([(stats[i] - x[k].mean(0)) / s for i in got.doc_id])
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z) - 0.5 * np.linalg.slogdet(c)[1])
    odds = (logs[1] - logs[0] + np.log(n[1] / n[0])) / 4
    assert np.allclose(got.score, 1 / (1 + np.exp(-odds)), atol=1e-6)
    assert quality.classify(docs, lab).count() == len(TEXTS) + 2 and quality.classify(none, lab.limit(0)).count() == 0
    assert quality.accepted(docs, lab.limit(0)).columns == docs.columns


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(130, 8)).round(1)
    x[70:90] = x[60]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (220, [0.0] * 8), (240, [float("nan")] * 8), (260, [1.0, None] * 4), (None, [1.0] * 8), (280, [])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))).collect()
    want = []
    for q in range(0, 130, 20):
        s = sorted((-float(sum(a * b for a, b in zip(x[q], x[i], strict=True))), i) for i in range(130) if i != q)[:20]
        want += [(q, k, i) for k, (_, i) in enumerate(s, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == want
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    far = neighbours.nearest(spark.createDataFrame([(k, [k * 1e200, 1.0]) for k in range(60)], "vec_id long, embedding array<double>")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in far) == [(0, k, k) for k in range(1, 21)] + [(q, k + 1, i) for q in (20, 40) for k, i in enumerate([i for i in range(1, 60) if i != q][:20])]


def test_language_model(spark, docs, none):
    got = {r.doc_id: r for r in language_model.score(docs.where("doc_id <> 3 OR copy = 'x'")).collect()}
    train, texts = Counter(), {i: t for i, t in enumerate(TEXTS) if i != 3}
    tokens = {i: [*(t.encode().lower().split() if t else []), b" "] for i, t in texts.items()}
    for i, ws in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(ws)
    n, v = sum(train.values()), len(train)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in train for w in ws), n)
        assert r.base_score == pytest.approx(sum(np.log10((train[w] + 1) / (n + v + 1)) for w in ws)) and r.score < 0
    assert language_model.score(none).count() == 0


def test_every_customer_of_a_dish_is_reseated():
    for count, mass, d in ((5, 3.0, 0.9), (40, 2.0, 0.3), (300, 5.0, 0.95), (3000, 60.0, 0.6)):
        logs, t = np.full(count + 1, -np.inf), np.arange(count + 1)
        logs[1] = 0
        with np.errstate(divide="ignore"):
            for n in range(1, count):
                logs = np.logaddexp(np.concatenate(([-np.inf], logs[:-1])), logs + np.log(np.maximum(n - d * t, 0)))
        weight = np.exp((logs + t * np.log(mass)) - (logs + t * np.log(mass)).max())
        weight /= weight.sum()
        got = language_model._seat(np.full(4000, count), np.full(4000, mass), d, np.random.default_rng(7).random(4000))
        mean = weight @ t
        assert abs(got.mean() - mean) < 5 * (weight @ (t - mean) ** 2 / 4000) ** 0.5
        assert np.abs(np.cumsum(np.bincount(got, minlength=len(t))) / 4000 - np.cumsum(weight)).max() < 0.03
    assert language_model._seat(np.array([0, 1, 2]), np.full(3, 1e9), 0.5, np.full(3, 0.5)).tolist() == [0, 1, 2]


def test_language_model_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(language_model, "BUCKET_BYTES", 50_000)  # several buckets, hot words among them
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), []
    for partitions, tasks in (("4", 1), ("9", 7)):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        found.append(language_model.score(docs.repartition(tasks)).toPandas().sort_values("doc_id"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert np.allclose(found[0].score, found[1].score, atol=1e-9) and np.allclose(found[0].base_score, found[1].base_score)


def test_language_model_beats_the_base(spark):
    got = language_model.score(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum()


def test_mixture(spark, docs, none):
    got = Counter((r.doc_id, r.text) for r in mixing.mix(docs, {"s0": 3.0, "s1": 1.0, None: 1.0}, target=60).collect())
    sizes = Counter("s" + r.source if r.source else "-" for r in docs.collect())
    want, equal = Counter(), Counter()
    for r in docs.collect():
        rate = round(60 * {"s0": 3, "s1": 1, None: 1}.get(r.source, 0) / 5 / sizes["s" + r.source if r.source else "-"], 9)
        parts = max(1, int(np.ceil(rate / 16)))
        others = "|".join("-" if r[c] is None else str(r[c]) for c in sorted(docs.columns) if c not in ("doc_id", "copy"))
        digest = "null" + hashlib.md5(others.encode()).hexdigest()
        for p in range(parts):
            name = f"{digest}.{equal[digest]}" if r.doc_id is None else r.doc_id
            u = int(hashlib.md5(f"42|{name}|{p}".encode()).hexdigest()[:13], 16) / 2**52
            k, term = 0, np.exp(-rate / parts)
            total = term
            while total <= u:
                k += 1
                term *= rate / parts / k
                total += term
            want[r.doc_id, r.text] += k
        equal[digest] += 1
    assert got == +want
    clash = docs.withColumns({"_source": F.lit(1), "_copies": F.lit(2), "row": F.lit(3), "_name": F.lit(4)})
    assert mixing.mix(clash).columns == [*(c for c in clash.columns if c != "copy"), "copy", "shuffle_key"]
    blank = spark.range(4000).selectExpr("cast(null as long) AS doc_id", "concat('text ', id) AS text", "'a' AS source")
    assert len({r.shuffle_key for r in mixing.mix(blank).collect()}) > 2000
    same = spark.range(70_000).selectExpr("cast(null as long) AS doc_id", "'' AS text", "'a' AS source", "'en' AS lang", "0L AS n_chars", "map('k', 1) AS m")
    found = mixing.mix(same.unionAll(same.limit(1).withColumn("doc_id", F.lit(7).cast("long"))))
    rows, keys, ids, drawn, maps = found.agg(F.count("*"), F.count_distinct("shuffle_key"), F.count("doc_id"), F.sum((F.col("copy") == 0).cast("int")), F.sum(F.col("m")["k"])).first()
    assert abs(rows - 70_001) < 1500 and keys == rows == maps and ids < 10 and abs(drawn / 70_001 - (1 - np.exp(-1))) < 0.01
    assert mixing.mix(none).count() == 0 and mixing.mix(docs, {}).count() == 0
    big = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS source")
    n = Counter(r.source for r in mixing.mix(big, {"a": 0.5, "b": 0.5}, target=6000).collect())
    assert abs(n["a"] - 3000) < 250 and abs(n["b"] - 3000) < 250


MIT_TEXT = """The MIT License (MIT)

Copyright (c) 2020 Some Holder. All rights.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD_TEXT = """Copyright (c) 2019, Some Holder
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of Some Holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
"""
APACHE_TEXT = """#!/usr/bin/env python
# Copyright 2021 Some Holder
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.

import os
"""
GNU_TEXT = """/*
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU %s Public License as published by
 * the Free Software Foundation%s either version %s of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 */"""
MPL_TEXT = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""
ISC_TEXT = """ISC License

Copyright (c) 2018, Some Holder

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
ZLIB_TEXT = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""
ADVERT = """3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement:
   This product includes software developed by the Some Organization.

4. Neither"""
LICENCE_CASES = [
    (ZLIB_TEXT, "Zlib", ""),
    (BSD_TEXT.replace("3. Neither", ADVERT), "BSD-4-Clause", ""),
    ("This project is licensed under the Apache License, Version 2.0.", "Apache-2.0", ""),
    ("Foo bar. This project is licensed under the MIT License - see LICENSE", "MIT", ""),
    ("This project is licensed under the MIT License - see the [LICENSE.md](LICENSE.md) file for details.", "MIT", ""),
    ("some words\nunder the terms of the MIT license\nmore words", "MIT", ""),
    ("This project is not licensed under the MIT License.", "", ""),
    ("A tale of a boat under the bridge. It is licensed under nothing.", "", ""),
    ("Licensed under https://creativecommons.org/licenses/by/4.0/", "CC-BY-4.0", ""),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC-BY-ND-4.0", ""),
    ("The text of this book is available under the CC BY-NC-SA 3.0 licence!", "CC-BY-NC-SA-3.0", ""),
    ("This library is distributed under the GNU LGPL v2.1 or later. Released under GPLv3.", "LGPL-2.1-or-later,GPL-3.0-only", ""),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "EPL-2.0", ""),
    ("SPDX-License-Identifier: EPL-2.0 OR Zlib", "EPL-2.0,Zlib", ""),
    ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nfoo", "WTFPL", ""),
    (MIT_TEXT, "MIT", ""),
    (MIT_TEXT.replace("\n", "\r\n"), "MIT", ""),
    ("/**\n" + "".join(f" * {x}\n" for x in MIT_TEXT.split("\n")) + " */\nint x;", "MIT", ""),
    (BSD_TEXT, "BSD-3-Clause", ""),
    (BSD_TEXT.replace("1. ", "(1) ").replace("2. ", "(2) ").replace("3. ", "(3) "), "BSD-3-Clause", ""),
    (BSD_TEXT[: BSD_TEXT.index("3. ")], "BSD-2-Clause", ""),
    (APACHE_TEXT, "Apache-2.0", ""),
    (GNU_TEXT % ("General", ";", "2"), "GPL-2.0-or-later", ""),
    (GNU_TEXT % ("General", ",", "3"), "GPL-3.0-or-later", ""),
    (GNU_TEXT % ("Lesser General", ";", "2.1"), "LGPL-2.1-or-later", ""),
    (GNU_TEXT % ("Affero General", ",", "3"), "AGPL-3.0-or-later", ""),
    (MPL_TEXT, "MPL-2.0", ""),
    (ISC_TEXT, "ISC", ""),
    ("// SPDX-License-Identifier: MIT\nint x;", "MIT", ""),
    ("# SPDX-License-Identifier: (Apache-2.0 OR MIT)\nx = 1", "Apache-2.0,MIT", ""),
    ("SPDX-License-Identifier: GPL-2.0+", "GPL-2.0-or-later", ""),
    ("Foo. Licensed under the Apache License, Version 2.0.\nReleased under the MIT License!", "Apache-2.0,MIT", ""),
    ("some words\nReleased under the MIT License\nmore words", "MIT", ""),
    ("This program is free software; nothing", "", "GPL-FREE"),
    ("an e-mail a@b.c; @MIT\n@", "", ""),
    ("." * 300_000 + ")" * 300_000 + "\n" * 300_000 + "Released under the MIT License.", "MIT", ""),
    (None, "", ""),
    ("", "", ""),
    (" \n\n\f1. a. ", "", ""),
]


def test_licences_as_published(spark, docs, none):
    rows = [(k, text) for k, (text, *_) in enumerate(LICENCE_CASES)] * 2 + [(None, MIT_TEXT)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = licences.scan(df).collect()
    assert sorted((r.doc_id, r.licences, r.leftovers) for r in got if r.doc_id is not None) == sorted((k, *want) for k, (_, *want) in enumerate(LICENCE_CASES) for _ in range(2))
    assert [r.licences for r in got if r.doc_id is None] == ["MIT"]
    assert licences.scan(docs).where("n_licences = 1").count() == 1 and licences.scan(none).count() == 0
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(map(str, con.execute(licences.oracle()).fetchall())) == sorted(str(tuple(r)) for r in got)


def test_every_licence_sentence_is_reachable(spark):
    """Each known sentence, wrapped at 60 columns, is one sentence with its own identifier."""
    rows = [(i, "\n".join(textwrap.wrap(s, 60))) for i, s in licences.SENTENCES.items() if not s.startswith(licences.TAG)]
    got = {r.doc_id: r.sentence_ids for r in licences.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert all(found == i for i, found in got.items()) and len(got) == len(rows)


def test_audio(spark, docs, monkeypatch):
    rng = np.random.default_rng(5)
    songs = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (6000, 6000, 200, 9000)]
    rows = [(0, songs[0]), (1, songs[0]), (2, songs[1]), (3, songs[1][640:] + songs[0]), (4, songs[2]), (5, b""), (6, None), (None, songs[0]), (50, songs[1]), (100, songs[3]), (7, songs[3]), (7, songs[3])]
    prints = audio.fingerprint(spark.createDataFrame(rows, "id long, audio binary").withColumn("fingerprint", F.lit(1)), "id", "audio", "u8", frame=256)
    by_id = [(r.id, np.frombuffer(r.fingerprint, "<u4")) for r in prints.collect()]
    got = [(r.query_id, r["rank"], r.match_id, r.offset, r.matches, r.bit_errors, r.overlap) for r in audio.align(prints).collect()]
    classes = defaultdict(set)
    for i, a in by_id:
        if i is not None and len(a):
            classes[a.tobytes()].add(i)
    want = [(i, 0, min(ids), 0, len(a) // 4, 0, len(a) // 4) for a, ids in classes.items() for i in ids - {min(ids)}]
    for q, a in by_id:
        if q is None or q % 50 or not len(a):
            continue
        found = []
        for raw, ids in classes.items():
            if ids == {q}:
                continue
            b = np.frombuffer(raw, "<u4")
            votes = Counter(j - i for i, x in enumerate(a >> 12) for j, y in enumerate(b >> 12) if x == y)
            if votes:
                n, shift = min((-n, s) for s, n in votes.items())
                found.append((n, min(ids), shift, *audio.bit_errors(a, b, shift)))
        want += [(q, k, c, s, -n, e, o) for k, (n, c, s, e, o) in enumerate(sorted(found)[:20], 1)]
    assert sorted(got) == sorted(want) and {(50, 2), (2, 3)} & {(g[0], g[2]) for g in got}
    monkeypatch.setattr(audio, "MATCHES", 3)
    monkeypatch.setattr(audio, "MANY", 3)
    assert sorted(got) == sorted((r.query_id, r["rank"], r.match_id, r.offset, r.matches, r.bit_errors, r.overlap) for r in audio.align(prints).collect())
    assert audio.align(prints.limit(0)).count() == 0


def test_votes_of_frequent_integers():
    rng = np.random.default_rng(1)
    for n, m, kinds in ((1, 1, 1), (900, 700, 2), (50, 3000, 1), (400, 400, 90), (5, 7, 1000)):
        a, b = (rng.integers(0, kinds, x) for x in (n, m))
        votes = Counter((j - np.flatnonzero(a == y)).tolist()[z] for j, y in enumerate(b) for z in range((a == y).sum()))
        most, shift = min(((-v, s) for s, v in votes.items()), default=(0, None))
        assert audio._votes(a, b)[0] == -most and (not most or audio._votes(a, b)[1] == shift)
    silent = np.zeros(300_000, np.uint32)
    assert audio._votes(silent, silent) == (300_000, 0)


def test_wav_rates_and_pitch_classes():
    def wav(hz, rate, channels=1, width=2):
        out, t = io.BytesIO(), np.arange(rate * 2) / rate
        with wave.open(out, "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(width)
            w.setframerate(rate)
            x = np.repeat(np.sin(2 * np.pi * hz * t), channels)
            w.writeframes((x * 20_000).astype("<i2").tobytes() if width == 2 else (x * 100 + 128).astype(np.uint8).tobytes())
        return out.getvalue()

    def heard(sound):
        power = np.abs(np.fft.rfft(sound[: audio.FRAME] * np.hanning(audio.FRAME))) ** 2
        return int((power @ audio._classes(audio.RATE, audio.FRAME)).argmax())

    for semitone in range(-12, 13):  # from 220 to 880 Hz
        for rate, channels, width in ((8000, 1, 2), (44_100, 2, 2), (16_000, 1, 1)):
            assert heard(audio.samples(wav(440 * 2 ** (semitone / 12), rate, channels, width))) == semitone % 12
    assert len(audio.samples(b"RIFFbroken")) == 5 and len(audio.samples(None)) == 0


def encoded(end):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, end]


def test_sequences(spark, docs, none):
    enc, at, want = encoded(0), 0, []
    rows = sorted(((-1 if r.doc_id is None else r.doc_id), r.text or "") for r in docs.collect())
    for i, t in rows:
        ids = enc(t)
        want.append((None if i < 0 else i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, sequences.encode_and_read_back(docs).collect()), key=lambda r: r[1]) == want
    assert sequences.encode_and_read_back(none).count() == 0
    ids, mask = sequences.SequenceFile(sequences.write_sequences(docs.where("doc_id = 10"), f"{spark.conf.get('spark.checkpoint.dir')}/masks")[0].path).sequence(0)
    assert len(ids) == len(mask) == 1024 and mask.dtype == np.uint8 and not mask.flags.owndata and int(mask.sum()) == min(1024, len(enc(TEXTS[10])))


def test_packing(spark, docs, none):
    enc, got = encoded(2), packing.pack(docs).collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(r.doc_id for r in docs.collect())
    ids = enc(TEXTS[7])
    parts = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == 7)
    assert [p[3] for p in parts] == [zlib.crc32(np.array(ids[p[1] : p[1] + p[2]], "<u4").tobytes()) for p in parts] and sum(p[2] for p in parts) == len(ids)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert places[0][0] == 0 and all(a + b == c for (a, b), (c, _) in itertools.pairwise(places)) and sum(places[-1]) <= 1024
    assert packing.pack(none).count() == 0
    many = spark.range(900).selectExpr("id AS doc_id", "CASE WHEN id % 3 > 0 THEN repeat('alpha beta ', cast(id % 700 AS int)) END AS text")
    got = packing.pack(many, with_ids=True).collect()
    assert sorted(r.doc_id for r in got if r.piece == 0) == list(range(900)) and len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)


def test_plan_is_best_fit():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sizes = rng.integers(1, 40, 300)
        rooms: list[int] = []
        for s in sorted(sizes, reverse=True):
            fit = [r for r in rooms if r >= s]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - s)
            else:
                rooms.append(40 - s)
        rows = packing.plan(Counter(sizes.tolist()), 40)
        used = {f + k for _, _, n, f, _ in rows for k in range(n)}
        assert len(used) == len(rooms) and sum(n for _, _, n, _, _ in rows) == 300


def test_minimum_cut_against_all_labellings():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        costs = [tuple(map(float, rng.integers(0, 9, 2))) for _ in range(n)]
        links = [(i, j, float(rng.integers(1, 5))) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]

        def cost(labels, costs=costs, links=links):
            return sum(c[x] for c, x in zip(costs, labels, strict=True)) + sum(c for i, j, c in links if labels[i] != labels[j])

        assert cost(html_cut.minimum_cut(costs, links)) == min(cost(x) for x in itertools.product((False, True), repeat=n))


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=/a>Menu entry<li><a href=/b>Other</ul></nav>
<div class="cookie-notice">We use cookies on this site, please agree.</div><article><h1>Big &amp; news</h1><p>First   paragraph with<br>some words, and <b>more</b> of them.<script>var x = "</p>";</script>
<p>Second one &lt;here&gt; closes the story.<form><input><label>Your mail address please</label></form><div id=comments><p>Nice article, thank you very much for it.</div></article>
<aside><p>Related things that nobody wants to read here.</p></aside><footer>&copy; us</footer></body>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<script>never closed"), (None, "u", "<p>" + "A long plain paragraph of text stands here. " * 3), (1, "u", PAGE)]
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in html_cut.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()))
    want = "Big & news\nFirst paragraph with some words, and more of them.\nSecond one <here> closes the story."
    assert [g[1] for g in got] == [("A long plain paragraph of text stands here. " * 3).strip(), want, want, "", "", ""] and all(len(t) == n for _, t, n in got)


def test_main_text_under_names_of_layout():
    story, said = "A paragraph of the story stands here, with some words. " * 9, "Nice article, thank you very much for it. " * 40
    want = story.strip()
    for around in ('<body class="single has-sidebar">%s', '<body><article class="post comments-open">%s</article>', '<body><div id="page" class="content no-sidebar">%s</div>', '<html class="cookie-consent"><body>%s', '<body><div class="widget">%s</div>'):
        assert html_cut.main_text(around % f"<p>{story}</p>") == want
    for name in ("comments", "comment-list", "site-footer"):  # even where they hold most of the text
        assert html_cut.main_text(f'<body class="has-sidebar"><article><p>{story}</p></article><div class="{name}"><p>{said}</p></div>') == want
        assert html_cut.main_text(f'<body><div class="post"><p>{story}</p></div><div class="{name}"><p>{said}</p></div>') == want


def test_main_text_of_all_pages(spark):
    """The articles of the given pages, read plainly: what stands in <article>, cut at block tags."""
    pages = spark.read.parquet(f"{SF}/../sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.sub(r"<!--.*?-->|<(script|style|form|aside)\b.*?</\1>|<(div|section) class=\"(?:ad|comments?|share|related)\".*?</\2>", "\n", re.search(r"<article\b[^>]*>(.*?)</article>", r.html, re.S)[1], flags=re.S)
        cut = re.split(r"</?(?:p|h[1-6]|ul|ol|li|div|section|blockquote|pre|table|tr|td|th|figure|figcaption)\b[^>]*>", inner)
        texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\b[^>]*>", " ", x))).split()) for x in cut]
        want[r.page_id] = "\n".join(x for x in texts if x)
    assert {r.page_id: r.text for r in html_cut.extract(pages).collect()} == want


def test_main_text_inside_articles():
    story = "The body of an article has words, many of them."
    for page, want in (
        (f'<article class="post share-price"><p>{story}</p></article>', story),
        (f'<div class="comment-free body"><p>{story}</p></div>', story),
        (f"<article><header><h1>The title</h1><a href=x>Someone</a></header><p>{story}</p></article>", f"The title\n{story}"),
        ("<p>One <math><mi>x</mi></math> is the unknown of all of them.</p>", "One x is the unknown of all of them."),
        (f"<ul><li>{story}<li>{story}</ul><table><tr><td>{story}<td>{story}<tr><td>{story}</table>", "\n".join([story] * 5)),
    ):
        assert html_cut.main_text(page) == want


def test_deep_nesting_takes_linear_time():
    for part in ("<div>words are here, yes.", '<div class="ad"><p>words', "<li><div><p>words", "<p><table>words<td>", "<div></b>", "<dl><dd><div>"):
        began = time.process_time()
        html_cut.main_text(part * 50_000)
        assert time.process_time() - began < 20


def test_golay():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 23, 4000)
    for errors in (0, 1, 2):
        other = words.copy()
        for k in range(len(words)):
            for b in rng.choice(23, errors, replace=False):
                other[k] ^= 1 << int(b)
        (a, ra), (b, rb) = golay.near_codewords(words), golay.near_codewords(other)
        assert all(set(x[m]) & set(y[n]) for x, m, y, n in zip(a, ra, b, rb, strict=True))


def fingerprint(t):
    ws = t.encode().lower().split() if t else []
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + 3]), 42) for i in range(max(1, len(ws) - 2))] if ws else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_against_all_pairs(spark, docs, none):
    rng = np.random.default_rng(9)
    base = [int(x) for x in rng.integers(0, 1 << 62, 40)]
    marks = set(base)
    for x in base:
        for _ in range(6):
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(b)
            marks.add(x)
    signed = sorted(m - (1 << 64) if m >> 63 else m for m in marks)
    got = simhash.links(spark.createDataFrame([(m,) for m in signed], "fingerprint long")).collect()
    assert {(max(r.u, r.v), min(r.u, r.v)) for r in got} == {(a, b) for b, a in itertools.combinations(signed, 2) if 0 < ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    rows = [(r.doc_id, fingerprint(r.text)) for r in docs.collect()]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
            group = [group[i] if g == group[j] else g for g in group]
    want = sorted(((i, f"{m:016x}", min((k for (k, _), h in zip(rows, group, strict=True) if h == g and k is not None), default=None)) for (i, m), g in zip(rows, group, strict=True)), key=str)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.first_of_each_group(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group))


def similar_groups(texts):
    """The smallest id of each text's group: sets of five-word shingles at similarity 0.8, by all pairs."""
    sets, root = {}, {i: i for i in texts}
    for i, t in texts.items():
        ws = t.encode().lower().split() if t else []
        sets[i] = {xxhash.xxh64_intdigest(b" ".join(ws[k : k + 5]), 42) for k in range(max(1, len(ws) - 4))} if ws else set()

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        either = len(sets[a] | sets[b])
        if len(sets[a] & sets[b]) >= 0.8 * either:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: top(i) for i in texts}


def test_similar_texts_against_all_pairs(spark, docs, none):
    rng, texts = np.random.default_rng(5), {}
    for base in range(12):
        words = text_of(100 + base, int(rng.integers(60, 400))).split()
        for copy in range(5):
            for at in rng.choice(len(words), copy * len(words) // 150, replace=False):
                words[at] = f"other{at}"
            texts[len(texts)] = " ".join(words)
    for n in (5, 8, 12, 20):  # few shingles: one more word, and one less alike
        texts[len(texts)] = text_of(900 + n, n)
        texts[len(texts)] = text_of(900 + n, n) + " nu"
        texts[len(texts)] = text_of(900 + n, n) + " nu xi omicron pi rho sigma"
    want = similar_groups(texts)
    made = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("node", "label", "u", "soft")})
    firsts, grouped = similar_text.groups(made)
    nodes, found = {r.node for r in firsts.collect()}, {r.u: r.v for r in grouped.collect()}
    assert nodes == {min(i for i, t in texts.items() if t == u) for u in texts.values()}
    assert len(set(want.values())) < len(nodes) - 12 and {i: found.get(i, i) for i in nodes} == {i: want[i] for i in nodes}
    kept = similar_text.first_of_each_group(made)
    assert kept.columns == made.columns and {r.doc_id for r in kept.collect()} == set(want.values())
    odd = similar_text.first_of_each_group(docs)
    assert odd.columns == docs.columns and {r.doc_id for r in odd.collect()} == {None, *similar_groups(dict(enumerate(TEXTS))).values()}
    assert similar_text.first_of_each_group(none).count() == 0


def test_a_large_group_of_near_copies(spark):
    """All link to one text and few to each other; beside them as many that are just too far from it."""
    rng, base, texts, near = np.random.default_rng(11), text_of(77, 204).split(), {0: text_of(77, 204)}, 0
    for i in range(1, 5001):
        words = base.copy()
        for at in rng.choice(40, 4 if i % 2 else 8, replace=False) * 5 + 2:
            words[at] = f"w{i}x{at}"
        texts[i] = " ".join(words)
    kept = similar_text.first_of_each_group(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).select("doc_id").collect()
    near = {i for i in texts if i % 2}  # 20 of 200 shingles change: 180 / 220
    assert len(kept) >= 2501
    assert len(near & {r.doc_id for r in kept}) <= 0.02 * len(near)


def test_texts_with_one_id(spark):
    rows = [(1, text_of(1, 60)), (1, text_of(2, 60)), (1, text_of(1, 60).upper()), (2, text_of(2, 60)), (3, text_of(1, 60) + " nu")]
    kept = similar_text.first_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text.lower()) for r in kept) == sorted((1, text_of(k, 60)) for k in (1, 2))


def test_soft_keys_meet_at_the_threshold():
    rng, cosine, n = np.random.default_rng(3), 8 / 9, 2000  # the least cosine of two sets of similarity 0.8
    a = rng.standard_normal((n, similar_text.BITS))
    b = cosine * a + (1 - cosine**2) ** 0.5 * rng.standard_normal(a.shape)
    (ka, ra), (kb, rb) = (similar_text.soft_keys(np.clip(np.rint(32 * x), -127, 127).astype(np.int8)) for x in (a, b))
    assert len({r for _, r in set(zip(ka.tolist(), ra.tolist(), strict=True)) & set(zip(kb.tolist(), rb.tolist(), strict=True))}) >= 0.97 * n


def test_pipeline_against_its_operators(spark):
    d, lab = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in quality.classify(d, lab).where("predicted = 1").collect()}
    first = set(similar_groups({r.doc_id: r.text for r in d.collect() if r.doc_id in good}).values())
    mixed = Counter(r.doc_id for r in mixing.mix(d.where(F.col("doc_id").isin(*first))).collect())
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == mixed
    assert all(r.offset + r.length <= 1024 for r in got)


def test_pipeline_stages_take_odd_rows(spark, docs, none):
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    for table in (docs.select(*plain), none.select(*plain)):
        out = table
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, SF)
        assert out.count() >= 0
