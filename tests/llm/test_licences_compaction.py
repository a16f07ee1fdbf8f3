import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tradelens.llm import compaction, licences
from tradelens.llm.common import read, scratch

DOCS = "doc_id long, text string, path string, licence string, line string"


def cosine(line):
    """By plain dictionaries: (-score, licence) of the best template."""
    terms = lambda t: Counter(x for x in re.findall(licences.TERM, t.lower()) if x not in licences.FUNCTION_WORDS)
    bags = [terms(t) for _, t in licences.TEMPLATES]
    df = Counter(t for b in bags for t in b)
    idf = lambda t: math.log((1 + len(bags)) / (1 + df[t])) + 1 if t in df else licences.UNSEEN
    vector = lambda b: {t: (1 + math.log(n)) * idf(t) for t, n in b.items()}
    norm = lambda v: math.sqrt(sum(w * w for w in v.values()))
    own = vector(terms(line))
    if not own:
        return 0.0, ""
    scores = [(round(sum(own.get(t, 0) * w for t, w in v.items()) / norm(v) / norm(own), 6), name) for v, (name, _) in zip(map(vector, bags), licences.TEMPLATES)]
    return min((-s, n) for s, n in scores)


WRAPPED = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */
int main() { return 0; }"""
UNITS = [
    "Released under the MIT License.", "  licensed under the apache license, version 2.0 ", "This work is licensed under the GNU General Public License, version 3.", "license plates are nice",
    "Licensed under CC BY-NC 4.0.", "warrant", "Copyright (c) 2020 Jane Doe. All rights reserved.", "GNU GENERAL PUBLIC LICENSE", "Apache License", licences._BSD, "the of and", "This program is free software",
]


def test_units_match_plain_cosine(spark):
    df = spark.createDataFrame([(x.lower(),) for x in UNITS], "unit string")
    df = licences.with_unit_key(df)
    got = {r.unit: (-r.score, r.licence) for r in licences.scored_units(df, 0.7, licences.template_vectors()).join(df, licences.UNIT_KEY).collect()}
    want = {x.lower(): cosine(x) for x in UNITS}
    assert got == {x: w for x, w in want.items() if -w[0] >= 0.7}
    assert len(got) >= 8


def test_no_unit_is_missed_for_its_terms():
    needed = licences.needed_terms(0.7, licences.template_vectors())
    pattern = re.compile(licences.any_of(needed))
    rng = random.Random(5)
    vocabulary = sorted({t for _, text in licences.TEMPLATES for t in re.findall(licences.TERM, text.lower())})
    for _ in range(1500):
        words = re.findall(licences.TERM, rng.choice(licences.TEMPLATES)[1].lower())
        unit = " ".join([w for w in words if rng.random() < 0.75] + rng.sample(vocabulary, rng.randrange(4)))
        if -cosine(unit)[0] >= 0.7:
            assert pattern.search(unit)
    for t in vocabulary:
        assert bool(pattern.search(f"x {t}, y")) == any(w in needed for w in re.findall(licences.TERM, t)) or t in needed


def test_headers_files_and_inline_licences(spark):
    body = "\n".join(f"value number{i} equals thing{i} here" for i in range(40))
    mit = f"MIT License\n\nCopyright (c) 2021 A. Person\n\n{licences._MIT}\n\n{licences._MIT_NOTICE}\n\n{licences._MIT_WARRANTY}\n"
    rows = [
        ("a/x.c", WRAPPED), ("a/y.c", body + "\n" + WRAPPED + body), ("b/LICENSE", mit), ("b/z", body), ("c/one", f"{body} Some words before. Released under the MIT License. And some words after it {body}"),
        ("d/notes", "We met, and spoke of licences, of permission and of rights, in general, all day long."), ("e/twenty", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen Licensed under CC BY 4.0. and so on and on"), ("e/w", body),
    ]
    got = scan(spark, rows)
    assert got[0][:2] == ("GPL-3.0", "header") or got[0][:2] == ("GPL-3.0", "file")
    assert got[1][:2] == ("GPL-3.0", "header")
    assert got[2] == ("MIT", "file", None) and got[3] == ("MIT", "directory", "b")
    assert got[4][:2] == ("MIT", "header") and got[5] == (None, None, None)
    assert got[6][:2] == ("CC-BY-4.0", "header") and got[7] == (None, None, None)


def test_query_against_brute_force(spark, small):
    from tradelens.llm.queries import op3_licence_scan

    needed = re.compile(licences.any_of(licences.needed_terms(0.7, licences.template_vectors())))
    got = {r.doc_id: r for r in op3_licence_scan(spark, small).collect()}
    docs = read(spark, small, "documents").collect()
    assert len(got) == len(docs)
    named = {r.doc_id: r.doc_id is not None and r.doc_id % 10 == 0 for r in docs}
    place = {r.doc_id: tuple("none" if x is None else str(x) for x in (r.source, r.lang, r.doc_id // 100)) for r in docs}
    own, files = {}, {}
    for r in docs:
        given = re.split(r"\r?\n|\r", r.text or "")
        bare = [re.sub(licences.COMMENT, "", x).strip(" ") for x in given]
        cut = lambda lines: [x for x in re.split("\n\n+", "\n".join(lines)) if needed.search(x.lower())]
        lines = [x for x in bare if needed.search(x.lower())]
        parts = lines + [s for x in lines for s in re.split(licences.SENTENCE, x)] + cut(bare) + cut([x if needed.search(x.lower()) else "" for x in bare])
        parts += cut([b + " " if re.match(licences.COMMENT_LINE, x) else "" for x, b in zip(given, bare)])
        if 2 * len(re.findall(r"\S+", " ".join(cut(bare)))) >= len(re.findall(r"\S+", r.text or "")) and needed.search((r.text or "").lower()):
            parts.append(re.sub(licences.COMMENT, "", r.text))
            is_file = -cosine(parts[-1])[0] >= 0.9
        else:
            is_file = False
        best = min((cosine(x) for x in set(parts)), default=(0.0, ""))
        if -best[0] >= 0.7:
            own[r.doc_id] = best
            if named[r.doc_id] or is_file:
                files.setdefault(place[r.doc_id], []).append(best)
    origins = Counter()
    for r in docs:
        if r.doc_id in own:
            want = own[r.doc_id][1], -own[r.doc_id][0]
        else:
            want = min(files[place[r.doc_id]])[1] if place[r.doc_id] in files else None, None
        assert (got[r.doc_id].licence, got[r.doc_id].score) == want
        origins[got[r.doc_id].origin] += 1
    assert origins["header"] > 5 and origins["file"] and origins["directory"]


def test_wrapped_headers_score_as_unwrapped_ones(spark):
    import textwrap

    code = "\n".join(f"value{i} = thing{i}(argument{i})" for i in range(60))
    texts = {"ISC": f"{licences._ISC} {licences._ISC_WARRANTY}", "ISC-part": licences._ISC_WARRANTY, "BSD": licences._BSD_TERMS, "BSD-part": licences._BSD_WARRANTY, "MIT": licences._MIT}
    rows = [(f"{n}/{w}/{m}", "\n".join(m + x for x in textwrap.wrap(t, w)) + "\n" + code) for n, t in texts.items() for w in (20, 25, 30, 40) for m in ("# ", "// ")]
    df = spark.createDataFrame([(i, t, p, "clash", "clash") for i, (p, t) in enumerate(rows)], DOCS)
    got = licences.scan(df, F.col("path")).collect()
    assert {(r.path.split("/")[0].split("-")[0], r.licence, r.score, r.origin) for r in got} == {(n, n, 1.0, "header") for n in ("ISC", "BSD", "MIT")}
    bare = [(f"d/{w}", "\n".join(textwrap.wrap(licences._BSD_TERMS, w)) + "\n\n" + code) for w in (20, 30)]  # no marks, but a blank line
    assert {v[:2] for v in scan(spark, bare).values()} == {("BSD", "header")}


def scan(spark, rows):
    df = spark.createDataFrame([(i, t, p, "clash", "clash") for i, (p, t) in enumerate(rows)], DOCS)
    return {r.doc_id: (r.licence, r.origin, r.licence_dir) for r in licences.scan(df, F.col("path")).collect()}


def test_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    body = "code " * 100
    rows = [("r/LICENSE", mit), ("r/a/x", body), ("r/a/b/COPYING", gpl + "\n" + body), ("r/a/b/c/y", body), ("r/a/b/z", body + "\n" + mit), ("q/x", body), (None, body), ("r/w", None), ("top", body), ("r/a/b/COPYING", gpl + "\n" + body), ("r2/x", "")]
    got = scan(spark, rows)
    assert got == {
        0: ("MIT", "file", None), 1: ("MIT", "directory", "r"), 2: ("GPL-3.0", "file", None), 3: ("GPL-3.0", "directory", "r/a/b"), 4: ("MIT", "header", None), 5: (None, None, None),
        6: (None, None, None), 7: ("MIT", "directory", "r"), 8: (None, None, None), 9: ("GPL-3.0", "file", None), 10: (None, None, None),
    }
    empty = spark.createDataFrame([], DOCS)
    assert licences.scan(empty, F.col("path")).count() == 0


def test_store(spark):
    store = compaction.ShardStore(spark, scratch(spark, "store"), target_bytes=1 << 20, fanout=3)
    schema = "k long, v string"
    for i in range(4):
        assert store.append(spark.createDataFrame([(i, "x"), (i, None), (None, "y")], schema).coalesce(1)) == i + 1
    old = store.manifest(2)
    version = store.compact()
    assert len(store.manifest()["shards"]) == 1 and version == 5
    assert store.read().count() == 12 and store.read(2).count() == 6 and store.manifest(2) == old
    store.append(spark.createDataFrame([(9, "x", 1.5)], schema + ", extra double"))
    assert store.read().where("extra = 1.5").count() == 1 and store.read().count() == 13
    with pytest.raises(RuntimeError):
        store._commit({"version": 3}, old["columns"], [])
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([("9", "x")], "k string, v string"))
    assert store.vacuum() >= 4 and store.read().count() == 13


def test_store_round_trip(spark, small):
    docs = read(spark, small, "documents")
    store = compaction.ShardStore(spark, scratch(spark, "store"))
    store.append_by(docs, F.col("source"))
    n = len(store.manifest()["shards"])
    store.compact()
    assert len(store.manifest()["shards"]) < n
    assert store.read().columns == docs.columns and store.read().exceptAll(docs).isEmpty() and store.read().count() == docs.count()


def test_empty_stores_and_clashing_names(spark):
    store = compaction.ShardStore(spark, scratch(spark, "store"))
    assert store.read().count() == 0 and store.compact() == 0
    schema = "_arrival string, _Arrival_ long, v string"
    empty = spark.createDataFrame([], schema)
    store.append_by(empty, F.col("v"))
    assert store.read().columns == empty.columns and store.read().count() == 0
    store.append(empty)
    rows = [("a", 1, None), ("a", 1, None), (None, None, "é" * 100_000)]
    store.append_by(spark.createDataFrame(rows, schema), F.col("v"))
    store.compact()
    assert sorted(map(tuple, store.read().collect()), key=str) == sorted(rows, key=str)


def test_a_tier_that_cannot_be_joined_leaves_the_others_to_be(spark):
    store = compaction.ShardStore(spark, scratch(spark, "tiers"), target_bytes=1 << 20, fanout=2, smallest=4096)
    rng = random.Random(1)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 3)
    try:
        for _ in range(2):
            store.append(spark.createDataFrame([(i, "x") for i in range(3)], "k int, text string").coalesce(1))
        for _ in range(2):
            store.append(spark.createDataFrame([(9, rng.randbytes(60_000).hex())], "k int, text string").coalesce(1))
        before = {s["path"]: s["tier"] for s in store.manifest()["shards"]}
        assert sorted(set(before.values())) == [0, max(before.values())] and len(before) == 4
        store.compact()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert sorted(s["tier"] > 0 for s in store.manifest()["shards"]) == [False, False, True] and store.read().count() == 8
