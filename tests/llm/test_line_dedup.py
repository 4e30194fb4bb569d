from collections import defaultdict

from pyspark.sql import functions as F

from loomspark.llm.line_dedup import line_dedup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOW)


def brute(rows, min_docs=5):
    held = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(-(2**63) if r[0] is None else r[0])
    out = []
    for r in rows:
        own = -(2**63) if r[0] is None else r[0]
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not (len(held[key(x)]) >= min_docs and own != max(held[key(x)]))]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_against_brute_force(docs, hard_docs):
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup(docs).collect()]
    assert sorted(got, key=str) == brute(hard_docs)
    assert sum(r[2] for r in got) == 10


def test_clashing_columns_stay_or_are_replaced(docs):
    out = line_dedup(docs.withColumns({"n_lines": F.lit("x"), "keys": F.lit(2)}))
    assert {"keys", "lang", "source"} <= set(out.columns)
    assert dict(out.dtypes)["n_lines"] == "bigint"


def test_empty_table(no_docs):
    assert line_dedup(no_docs).count() == 0
