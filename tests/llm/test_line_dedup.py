"""Line dedup against a brute-force version."""

import random

from pyspark.sql import functions as F

from shopmetrics.llm import line_dedup


def plain(rows, size=3):
    """rows: (id, text), ids unique."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out[i] = (0, 0, 0, None)
            continue
        lines, gone = t.split("\n"), set()
        for p in range(len(lines) - size + 1):
            w = tuple(lines[p:p + size])
            if not "".join(w).strip(" \t\r\f\x0b"):
                continue
            if w in seen:
                gone |= set(range(p, p + size))
            seen.add(w)
        spans = sum(1 for x in gone if x - 1 not in gone)
        out[i] = (len(lines), len(gone), spans, "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_equals_brute_force(lspark, make_docs):
    rng = random.Random(8)
    texts = [None, "", "a", "a\nb", "a\nb\nc", "a\nb\nc", "\n\n\n\n\n", " \n\t\n\n\n", "x\n" * 12, "a\nb\nc\nd", "b\nc\nd\na\nb\nc\n"]
    texts += ["\n".join(rng.choice("abcdé") for _ in range(rng.randint(0, 14))) for _ in range(60)]
    texts += ["\n".join(f"line {k}" for k in range(4000))] * 2
    rows = list(zip(rng.sample(range(1000), len(texts)), texts))
    out = line_dedup.remove_repeated(make_docs(rows), count=True).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["n_spans"], r["text"]) for r in out} == plain(rows)


def test_repeated_rows_null_ids_and_clashing_columns(lspark, make_docs):
    docs = make_docs([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "q\nr\ns"), (7, "q\nr\ns\nt"), (1, "z\na\nb\nc")])
    docs = docs.withColumn("dedup_t", F.lit("x")).withColumn("starts", F.lit(1)).withColumn("l", F.lit(2)).withColumn("salt", F.lit(3))
    out = line_dedup.remove_repeated(docs)
    assert out.columns == docs.columns
    got = sorted((str(r["doc_id"]), r["text"]) for r in out.collect())
    # Of the two texts of id 1, the one with the smaller hash comes first; its two equal rows are one document.
    assert got in ([("1", ""), ("1", ""), ("1", "z\na\nb\nc"), ("7", "t"), ("None", "q\nr\ns")],
                   [("1", "a\nb\nc"), ("1", "a\nb\nc"), ("1", "z"), ("7", "t"), ("None", "q\nr\ns")])


def test_empty(lspark, make_docs):
    assert line_dedup.remove_repeated(make_docs([])).collect() == []


def test_own_columns_with_the_names_of_the_figures(lspark, make_docs):
    docs = make_docs([(1, "a\nb\nc"), (2, "a\nb\nc\nd")]).withColumn("n_lines", F.lit("own"))
    out = {r["doc_id"]: (r["n_lines"], r["n_lines_"], r["n_removed"]) for r in line_dedup.remove_repeated(docs, count=True).collect()}
    assert out == {1: ("own", 3, 0), 2: ("own", 4, 3)}
