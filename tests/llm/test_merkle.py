import hashlib
import string
import zlib

import duckdb
import pytest

from tradelens.llm import merkle
from tradelens.llm.common import read

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return sha(field(r["doc_id"]) + field(r["source"]) + field(r["lang"]) + field(r["n_chars"]) + field(text))


def climbed(digests):
    """The root, and for each node the digests left and right of it, level by level."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for i in range(len(digests)):
            first = at[i] // 8 * 8
            run = level[first : first + 8]
            paths[i].append(("".join(run[: at[i] - first]), "".join(run[at[i] - first + 1 :])))
            at[i] //= 8
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
    return level[0], paths


def brute(rows):
    by = {}
    for r in rows:
        turned = r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        own = leaf(r, r["text"])
        by.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, own, leaf(r, r["text"].translate(LOWER)) if turned else own))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort()
        trees[lang] = climbed([x[2] for x in by[lang]])
    root, tops = climbed([trees[lang][0] for lang in langs]) if langs else (None, [])
    out = []
    for lang, top in zip(langs, tops):
        for (known, doc_id, own, other), path in zip(by[lang], trees[lang][1]):
            f = other
            for a, b in path + top:
                f = sha(a + f + b)
            out.append((doc_id if known else None, own, trees[lang][0], root, sha("".join(a + b for a, b in path + top)), f, f == root))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, merkle.manifest(df, merkle.tampering()).drop("path").collect()), key=repr)


def test_whole_table_is_the_brute_force_and_the_sql(spark):
    df = read(spark, "/root/testdata/sf0.01", "documents")
    want = brute([r.asDict() for r in df.collect()])
    assert result(df) == want
    assert 0 < sum(not w[-1] for w in want) < len(want)
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    assert sorted(con.execute(merkle.oracle_sql()).fetchall(), key=repr) == want


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513])
def test_sizes_around_runs_and_blocks(spark, n):
    rows = [(i * 7 % n, "A" * (i % 5), "x", "s", i) for i in range(n)]
    assert result(spark.createDataFrame(rows, DOCS)) == brute([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows])


def test_nulls_empty_long_and_repeated_rows(spark):
    rows = [(1, None, None, None, None), (None, "B", None, "s", 1), (None, "B", None, "s", 1), (2, "", "é", "s", 0), (2, "", "é", "s", 0), (3, "Ä" * 200_000 + "Z", "z", "", 5), (3, "other", "z", "", 5), (-6, "Q", "", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    want = brute([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows])
    assert result(df) == want
    clash = df.withColumnsRenamed({}).selectExpr("*", "1 AS leaf", "2 AS rank", "3 AS path", "4 AS size", "5 AS block", "6 AS root")
    assert result(clash) == want


def test_many_groups_and_empty_table(spark):
    rows = [(i, "T", f"l{i % 70}", "s", i) for i in range(150)]
    assert result(spark.createDataFrame(rows, DOCS)) == brute([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows])
    assert result(spark.createDataFrame([], DOCS)) == []


def test_a_proof_verifies_its_own_leaf_only(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, f"t{i}", "x", "s", i) for i in range(100)], DOCS)
    rows = merkle.manifest(df, F.col("doc_id") == 5, F.lit("forged")).collect()
    assert [r.doc_id for r in rows if not r.verified] == [5]
    assert len({r.root for r in rows}) == 1
