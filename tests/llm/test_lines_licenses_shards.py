import hashlib
import math
import os
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from conftest import SF

from strandloom.llm import common, op4_jaccard, op6_licenses, op7_line_dedup, op9_sharding


def oracle(sql, sf=SF, files="/documents.parquet"):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}{files}'")
    rel = con.sql(sql)
    return sorted(dict(zip(rel.columns, r)).items() for r in rel.fetchall())


def rows(df):
    return sorted(r.asDict().items() for r in df.collect())


def by_id(found):
    return {dict(r)["doc_id"]: dict(r) for r in found}


def test_lines_against_sql(spark):
    assert by_id(rows(op7_line_dedup.op7_line_dedup(spark, SF))) == by_id(oracle(op7_line_dedup.OP7_SQL))


def test_components_against_sql(spark):
    assert by_id(rows(op4_jaccard.op4_jaccard(spark, SF))) == by_id(oracle(op4_jaccard.OP4_SQL))


def test_licenses_against_sql(spark):
    assert by_id(rows(op6_licenses.op6_licenses(spark, SF))) == by_id(oracle(op6_licenses.OP6_SQL))


@pytest.mark.parametrize("mounted", [True, False])
def test_lines_in_many_shards(docs, monkeypatch, mounted):
    """A large index as files that workers map; without a folder for them, as files that Spark fetches. Either way in one pass."""
    once = by_id(rows(op7_line_dedup.dedup_lines(docs)))
    monkeypatch.setattr(op7_line_dedup, "KEYS_PER_SHARD", 1)
    monkeypatch.setattr(op7_line_dedup, "OPEN_SHARDS", 2)
    if not mounted:
        monkeypatch.setattr(common, "mounted_dir", lambda spark: None)
    small = {"broadcast_bytes": op7_line_dedup.KEY_BYTES}
    assert by_id(rows(op7_line_dedup.dedup_lines(docs, **small))) == once
    carried = op7_line_dedup.dedup_lines(docs, **small, carry=True)
    assert by_id(rows(carried.select("doc_id", "n_lines", "n_dropped", "kept_text"))) == once
    assert carried._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert any(r["n_dropped"] for r in once.values())


def test_a_missing_shard_is_an_error(docs, monkeypatch):
    """A worker that can't see a shard which was built doesn't take it for an empty one."""
    monkeypatch.setattr(op7_line_dedup, "KEYS_PER_SHARD", 1)
    made = []
    monkeypatch.setattr(common, "mounted_dir", lambda spark, own=common.mounted_dir: made.append(own(spark)) or made[-1])
    kept = op7_line_dedup.dedup_lines(docs, broadcast_bytes=op7_line_dedup.KEY_BYTES)
    gone = min(int(x) for x in os.listdir(made[0]) if x.isdigit())
    os.remove(f"{made[0]}/{gone}")
    with pytest.raises(Exception, match=f"piece {gone} of an index is missing"):
        kept.collect()


def test_documents_are_told_apart_by_id(spark):
    line = "a line of more than forty code points in all rows"
    df = spark.createDataFrame([(k // 2, line) for k in range(8)], "doc_id long, text string")
    assert all(r.n_dropped == 0 for r in op7_line_dedup.dedup_lines(df).collect())
    assert {r.doc_id: r.n_dropped for r in op7_line_dedup.dedup_lines(df, min_docs=4).collect()} == {0: 1, 1: 1, 2: 1, 3: 0}
    with pytest.raises(TypeError):
        op7_line_dedup.dedup_lines(df.selectExpr("cast(doc_id AS string) AS doc_id", "text"))


def test_lines_of_odd_rows(spark, odd, empty):
    got = op7_line_dedup.dedup_lines(odd, carry=True)
    assert got.count() == odd.count() and "SHARD" in got.columns
    assert {(r.n_lines, r.kept_text) for r in got.filter("doc_id in (2, 3)").collect()} == {(1, "")}
    assert op7_line_dedup.dedup_lines(empty).count() == 0
    line = "x" * 40
    df = spark.createDataFrame([(k, f" {line.upper() if k in (1, 3) else line}\t\nmine {k}") for k in [*range(5), None]], "doc_id long, text string")
    kept = {r.doc_id: r.n_dropped for r in op7_line_dedup.dedup_lines(df).collect()}
    assert kept == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0, None: 1}


def test_perfect_hash():
    rng = np.random.default_rng(3)
    h1, h2 = rng.integers(0, 2**63, 5000, np.uint64), rng.integers(0, 2**63, 5000, np.uint64)
    perfect = op7_line_dedup.PerfectHash(h1, h2)
    assert sorted(perfect.find(h1, h2)) == list(range(5000)) and perfect.size == 5000
    assert (perfect.find(h1 + np.uint64(1), h2) < 5000).all()


def test_licenses_by_lookup(spark):
    """Names within longer sentences, many licences, appendices that quote a notice, and no statement where there is none."""
    gpl = "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nEveryone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.\n\n"
    notice = WRAPPED["GPL-3.0-or-later"]
    rows = [
        ("MIT", "Released under the MIT License (see LICENSE)."),
        ("Apache-2.0", "Licensed under the Apache License, Version 2.0, and may be used"),
        ("Apache-2.0,MIT", "// SPDX-License-Identifier: Apache-2.0\n\nThis library is\ndistributed under the MIT\nlicense, with thanks."),
        ("GPL-3.0", gpl + "How to Apply These Terms to Your New Programs\n\n" + notice),
        ("GPL-3.0,GPL-3.0-or-later", gpl + notice),
        ("BSL-1.0", op6_licenses.SENTENCES["boost-grant"] + ":"),
        ("Zlib", "This software is provided 'as-is', without any express or implied\nwarranty.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:"),
        ("EPL-2.0", "Eclipse Public License - v 2.0\n\nTHE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC\nLICENSE (\"AGREEMENT\")."),
        ("", "It is licensed under the terms that we agreed on.\nThe permission slip is provided under the table."),
        ("", "the licensed\nunder\nMIT"),
        ("LGPL-2.1", "This package is licensed under the GNU Lesser General Public License, version 2.1."),
        ("GPL-3.0-or-later", "This program is licensed under the GNU General Public License version 3 or later\n"),
    ]
    rows += [(license, f"This software is licensed under the {name}.") for license, own in op6_licenses.NAMES.items() for name in own]
    assert len(op6_licenses.NAMES) >= 50
    df = spark.createDataFrame([(k, text, want) for k, (want, text) in enumerate(rows)], "doc_id long, text string, want string")
    for r in op6_licenses.scan(df, carry=True).collect():
        assert r.licenses == r.want, (r.text, r.sentence_ids)


def test_every_sentence_has_a_keyword():
    known = op6_licenses.Known(op6_licenses.SENTENCES, op6_licenses.NAMES)
    for text in (*known.whole, *known.gaps, *known.statements):
        assert any(word in text for word in op6_licenses.KEYWORDS), text


def test_licenses_do_not_hang_on_the_number_of_sentences(spark):
    """Thousands of further sentences are a larger set to look in, not more expressions."""
    few = op6_licenses.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
    many = {**op6_licenses.SENTENCES, **{f"more-{k}": f"the license number {k} holds for this part of the text" for k in range(3000)}}
    made = op6_licenses.scan(spark.createDataFrame([(1, "The license number 2999 holds\nfor this part of the text.")], "doc_id long, text string"), known=many)
    assert made.first().sentence_ids == "more-2999"
    count = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction")
    assert count(made) == count(few)


def test_license_rules(spark, odd, empty):
    bsd = "\n".join(op6_licenses.SENTENCES[k].capitalize() + "." for k in ("bsd-grant", "bsd-source", "bsd-binary"))
    mixed = "\n".join(op6_licenses.SENTENCES[k] for k in ("bsd-source", "bsd-grant", "bsd-binary"))
    df = spark.createDataFrame([(1, bsd), (2, mixed), (3, "Foo. LICENSED under the Apache License, Version 2.0.  Bar."), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in op6_licenses.scan(df).collect()}
    assert got[1].licenses == "BSD-2-Clause" and got[1].rules == "bsd2-text"
    assert got[2].n_known == 3 and got[2].licenses == ""
    assert got[3].licenses == "Apache-2.0" and got[4].licenses == "" and got[4].n_known == 0
    assert op6_licenses.scan(odd).count() == odd.count() and op6_licenses.scan(empty).count() == 0


def test_shards(spark, docs):
    got = op9_sharding.op9_sharding(spark, SF).collect()
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    slots = defaultdict(list)
    for r in got:
        assert (r.size, r.text_crc32, r.law) == (len(text[r.doc_id]) + 16, zlib.crc32(text[r.doc_id]), "key")
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert len(got) == len(text) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def drawn(doc_id, tree, path=""):
    """The shard of an id by the least weighted draw at each level, in plain Python."""
    if not isinstance(tree, dict):
        return int(path.rsplit("/", 1)[1])
    weight = lambda node: sum(map(weight, node.values())) if isinstance(node, dict) else node
    best = None
    for i, (name, child) in enumerate(tree.items()):
        if weight(child) > 0:
            seed = 42 if doc_id is None else xxhash.xxh64_intdigest(str(doc_id).encode(), 42)
            u = ((xxhash.xxh64_intdigest(f"{path}/{name}".encode(), seed) >> 11) + 0.5) / 2**53
            best = min(best or (math.inf,), (-math.log(u) / weight(child), i, f"{path}/{name}", child))
    return drawn(doc_id, best[3], best[2])


def test_shards_against_plain_draws(spark, docs, odd):
    """Shards, grown shards and slots, each computed anew."""
    tree = op9_sharding.tree(op9_sharding.SHARDS)
    more = op9_sharding.grown(tree)
    df = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    want, order = [], defaultdict(list)
    for r in df.collect():
        data = (r.text or "").encode()
        size, crc = len(data) + 16, zlib.crc32(data)
        seed = 42 if r.doc_id is None else xxhash.xxh64_intdigest(str(r.doc_id).encode(), 42)
        for number in (size, crc):
            seed = xxhash.xxh64_intdigest(number.to_bytes(8, "little"), seed)
        part = (seed - (seed >> 63 << 64)) % op9_sharding.PARTS
        order[drawn(r.doc_id, tree)].append((part, r.doc_id is not None, r.doc_id or 0, crc, size))
    for shard, own in order.items():
        for slot, (_, known, i, crc, size) in enumerate(sorted(own)):
            i = i if known else None
            want.append((str(i), size, crc, "key", shard, slot, drawn(i, more)))
    assert sorted((str(r[0]), *r[1:]) for r in op9_sharding.assign(df, tree, more).collect()) == sorted(want)
    as_int = op9_sharding.assign(df.selectExpr("cast(doc_id AS int) AS doc_id", "text"), tree, more).collect()
    assert sorted((str(r[0]), *r[1:]) for r in as_int) == sorted(want)


def test_one_id_of_many_rows(spark):
    """A third of the rows have no id: their slots have no gaps, and they are numbered in many parts."""
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 > 0 THEN id END AS doc_id", "concat('text ', id) AS text")
    got = op9_sharding.assign(df, op9_sharding.tree(3)).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len({r.shard for r in got if r.doc_id is None}) == 1 and len(got) == 3000
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_and_confined_moves(spark):
    ids = spark.range(40000).withColumnRenamed("id", "doc_id")
    tree = {"a": {"r1": {0: 1.0, 1: 3.0}, "r2": {2: 2.0}}, "b": {"r3": {3: 2.0, 4: 0.0}}}
    changed = {**tree, "a": {**tree["a"], "r1": {0: 3.0, 1: 1.0}}}  # same weight of r1: moves stay inside it
    got = ids.select(op9_sharding.place(op9_sharding.F.col("doc_id"), tree).alias("x"), op9_sharding.place(op9_sharding.F.col("doc_id"), changed).alias("y")).collect()
    share = np.bincount([r.x for r in got], minlength=5) / len(got)
    assert np.allclose(share, [1 / 8, 3 / 8, 2 / 8, 2 / 8, 0], atol=0.01)
    assert {(r.x, r.y) for r in got if r.x != r.y} == {(1, 0)}


def test_shards_of_odd_rows(odd, empty):
    got = op9_sharding.assign(odd, op9_sharding.tree(3)).collect()
    assert len(got) == odd.count() and all(r.grown_shard is None for r in got)
    assert len({(r.shard, r.slot) for r in got}) == len(got)
    assert op9_sharding.assign(empty, op9_sharding.tree(3)).count() == 0


def test_digest_is_of_the_kept_lines(spark):
    one = op7_line_dedup.op7_line_dedup(spark, SF).join(op7_line_dedup.dedup_lines(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id", "kept_text"), "doc_id").first()
    assert one.kept_sha256 == hashlib.sha256(one.kept_text.encode()).hexdigest()


WRAPPED = {
    "MIT": """MIT License

Copyright (c) 2020 Some One

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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "BSD-2-Clause,BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
}


def test_wrapped_notices(spark):
    """Notices as they are published, plain and in comments, with either line end."""
    rows = []
    for name, text in WRAPPED.items():
        marked = [("", ""), ("# ", ""), (" * ", ""), ("// ", "\r"), ("    ", "\r")]
        rows += [(name, "\n".join((a + line).rstrip() + end for line in text.split("\n"))) for a, end in marked]
        rows.append((name, "/*\n" + "\n".join(" * " + line for line in text.split("\n")) + "\n */\nint main() {}\n"))
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, want string, text string")
    for r in op6_licenses.scan(df, carry=True).collect():
        assert r.licenses == r.want, (r.text, r.sentence_ids)


def test_joined_lines_count_once(spark):
    cases = {
        "Licensed under\nthe MIT License": "mit-name",
        "Foo\nLicensed under the MIT License\nAll rights reserved\nbar": "mit-name,reserved",
        "Licensed under the\n\nMIT License": "",
        "Licensed under. The MIT License": "",
        "x Licensed under\nthe MIT License": "",
        "All rights\nreserved y": "",
        " * SPDX-License-Identifier:\n * MIT": "mit-name",
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.sentence_ids for r in op6_licenses.scan(df).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())


def test_licenses_of_larger_tables(spark):
    sf = "/root/testdata/sf0.01"
    assert by_id(rows(op6_licenses.op6_licenses(spark, sf))) == by_id(oracle(op6_licenses.OP6_SQL, sf))


def test_wrapped_texts_against_sql(spark, tmp_path):
    """Notices in comments, cut short, mixed and joined with other lines, by both."""
    rng = random.Random(4)
    known = [v.replace("*", "some one of the authors") for v in op6_licenses.SENTENCES.values()]
    texts = list(WRAPPED.values())
    for _ in range(150):
        out = []
        for _ in range(rng.randint(1, 4)):
            words = rng.choice([*known, "Copyright 2020 Some One", "see http x y", "v. 2.0 of it"]).split()
            if rng.random() < 0.2:
                words = words[: rng.randint(1, len(words))]
            line = "".join(w + rng.choice([" "] * 8 + ["\n", "\n * ", "  ", ", "] + ["\n\n"] * (rng.random() < 0.1)) for w in words)
            out.append(rng.choice(["", "# ", "1. ", "b) ", "(iv) ", "word "]) + line.strip(" \n*") + rng.choice([".", "", ";", "!"]))
        texts.append(rng.choice(["\n", "\n\n", " ", ". "]).join(out))
    spark.createDataFrame([*enumerate(texts), (10**6, None), (10**6 + 1, "")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = by_id(rows(op6_licenses.op6_licenses(spark, str(tmp_path))))
    assert got == by_id(oracle(op6_licenses.OP6_SQL, f"{tmp_path}/documents.parquet", "/*.parquet"))
    assert sum(r["n_known"] > 1 for r in got.values()) > 20


def test_names_in_sentences(spark):
    """A gap takes in one to eight words."""
    grant = WRAPPED["ISC"].split("\n\n")[0]
    tail = 'THE SOFTWARE IS PROVIDED "AS IS" AND {} DISCLAIMS ALL WARRANTIES WITH REGARD\nTO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND\nFITNESS.'
    names = ["ISC", "THE AUTHOR", "ACME\nCORPORATION AND ITS MANY SUBSIDIARIES", "", "ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE"]
    df = spark.createDataFrame([(k, grant + "\n\n" + tail.format(x)) for k, x in enumerate(names)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in op6_licenses.scan(df).collect()}
    assert [got[k] for k in range(len(names))] == ["ISC", "ISC", "ISC", "", ""]


WHOLE = {"GPL-3": "GPL-3.0", "GPL-2": "GPL-2.0", "LGPL-3": "LGPL-3.0", "LGPL-2.1": "LGPL-2.1", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}


@pytest.mark.parametrize("name", WHOLE)
def test_whole_licence_texts(spark, name):
    """Licence files as a distribution ships them."""
    path = f"/usr/share/common-licenses/{name}"
    if not os.path.exists(path):
        pytest.skip("no such file here")
    with open(path, encoding="utf-8") as f:
        df = spark.createDataFrame([(1, f.read())], "doc_id long, text string")
    assert WHOLE[name] in op6_licenses.scan(df).first().licenses.split(",")
