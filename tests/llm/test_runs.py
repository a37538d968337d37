"""Whole repeated runs of lines against a plain version."""

import pytest
from pyspark.sql import functions as F

from graphloom.llm import linededup


def plain(rows):
    """Each row's kept lines and numbers of removed lines and runs: pairs of neighbouring lines looked up in all earlier places."""
    key = lambda i: -(1 << 63) if i is None else i
    lines = [(t or "").split("\n") for _, t in rows]
    out = []
    for r, (i, t) in enumerate(rows):
        ls, at = lines[r], []
        for p in range(len(ls) - 1):
            pair = ls[p : p + 2]
            other = any(key(j) < key(i) and any(m[q : q + 2] == pair for q in range(len(m) - 1)) for (j, _), m in zip(rows, lines))
            if other or any(ls[q : q + 2] == pair for q in range(p - 1)):
                at.append(p)
        runs = []
        for p in at:
            if runs and runs[-1][1] == p + 1:
                runs[-1][1] = p + 2
            else:
                runs.append([p, p + 2])
        runs = [x for x in runs if "".join(ls[x[0] : x[1]]).strip(" \t\r\f\v")]
        gone = {p for a, b in runs for p in range(a, b)}
        out.append((i, t if not gone else "\n".join(x for p, x in enumerate(ls) if p not in gone), 0 if t is None else len(ls), len(gone), len(runs)))
    return out


def test_repeated_runs(spark, rng):
    body = "\n".join(f"line {i} of a passage" for i in range(12))
    rows = [(1, "top\n" + body), (2, "a\n" + body + "\nb"), (3, body), (4, None), (5, ""), (6, "x\n\n\n\ny"), (7, "z\n\n\n\n\nw"), (8, "q\nq\nq\nq\nq"), (None, "b\nc"), (9, "a\nb\nc"), (9, "a\nb\nc"), (9, "c\na\nb")]
    rows += [(20 + i, "\n".join(rng.choice("abcd ") for _ in range(rng.randint(1, 9)))) for i in range(40)]
    got = linededup.dedup_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(map(tuple, got), key=order) == sorted(plain(rows), key=order)
    whole = {r.doc_id: r for r in got}
    assert whole[2].text == "a\nb" and whole[2].removed_lines == 12 and whole[3].text == "" and whole[8].text == "q\nq"


@pytest.mark.parametrize("clean", [linededup.dedup_lines, linededup.dedup_runs])
def test_any_columns_ids_and_empty_tables(spark, clean):
    text = "one line\nand two\nand three\nfour\nfive\nsix"
    names = "hashes rolling starts spans lines dk tk at removed own body h others doc span n".split()
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in [*names, "a.b"])
    rows = [(i, t, *(f"{n}{i}" for n in [*names, "a.b"])) for i, t in ((1, text), (2, f"other\n{text}"), (None, None), (3, ""))]
    df = spark.createDataFrame(rows, schema)
    got = {r.doc_id: r.asDict() for r in clean(df).collect()}
    plain = {r.doc_id: r.text for r in clean(df.select("doc_id", "text")).collect()}
    assert {i: r["text"] for i, r in got.items()} == plain and len(plain[2]) < len(text)
    for i, _, *values in rows:
        assert [got[i][n] for n in [*names, "a.b"]] == values
    by_name = clean(df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"))))
    assert {r.doc_id: r.text for r in by_name.collect()} == {i and f"d{i}": t for i, t in plain.items()}
    assert clean(df.limit(0)).collect() == []
