import random
from collections import Counter

import duckdb
import pytest

from routelens.llm import line_suffix_array as ls


def brute(rows, m):
    """Kept text of each (doc_id, text), by comparing all runs of m lines."""
    seqs = {}
    for doc, text in sorted({(d, t or "") for d, t in rows}, key=lambda r: r[0]):
        lines = text.split("\n")
        seqs[doc] = [(i, x.strip(" \t\r")) for i, x in enumerate(lines) if x.strip(" \t\r")]
    seen, out = set(), {}
    for doc, seq in seqs.items():
        gone = set()
        for i in range(len(seq) - m + 1):
            run = tuple(x for _, x in seq[i : i + m])
            if run in seen:
                gone |= {n for n, _ in seq[i : i + m]}
            seen.add(run)
        out[doc] = gone
    return out


def texts(rng, n):
    return [(i, None if i == 4 else "\n".join(rng.choice(["a", "b ", " b", "c", "", "d", "e"]) + (str(rng.randrange(3)) if rng.random() < 0.3 else "") for _ in range(rng.randrange(12)))) for i in range(n)]


@pytest.mark.parametrize("m", [1, 2, 4])
def test_equals_brute_force(spark, m):
    rows = texts(random.Random(m), 120)
    docs = spark.createDataFrame([(i, t, "en", len(t or "")) for i, t in rows], "doc_id long, text string, key string, n_chars long").repartition(5)
    got = {r.doc_id: r for r in ls.dedup_lines(docs, m).collect()}
    gone = brute(rows, m)
    assert len(got) == len(rows)
    for i, t in rows:
        want = "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone[i])
        assert (got[i].text or "") == want and got[i].key == "en"
        assert got[i].n_chars == (None if t is None else len(want))


def test_equals_plainly_sorted_suffix_array(spark):
    rng = random.Random(6)
    block = ["p%d" % i for i in range(13)]
    rows = [(i, "\n".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))) for i in range(30)]
    rows += [(100 + i, "\n".join(["u%d" % i, *block[rng.randrange(4) : 13 - rng.randrange(4)], "v%d" % (i % 2), *block[: rng.randrange(13)]])) for i in range(8)]
    rows += [(200, "\n".join("ab" * 9)), (201, rows[3][1]), (202, "\n".join(["a", "only here"]))]
    texts = {}
    for d, t in rows:
        texts.setdefault(t, d)
    seqs = {d: t.split("\n") for t, d in texts.items()}
    shared = Counter(x for q in seqs.values() for x in q)
    suffixes = {(d, i): tuple(q[i:]) for d, q in seqs.items() for i in range(len(q)) if shared[q[i]] > 1}
    lcp = lambda x, y: next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    found = sorted(ls.suffix_array(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect(), key=lambda r: r.place)
    assert {(r.key, r.at) for r in found} == set(suffixes)
    # Lines are ordered by their identifiers, so the order is that of the suffixes under some order of the lines.
    order = {x: n for n, x in enumerate(dict.fromkeys(suffixes[r.key, r.at][0] for r in found))}
    names = [suffixes[r.key, r.at] for r in found]
    assert len(order) == len({x[0] for x in names}) and [n[0] for n in names] == sorted((n[0] for n in names), key=order.get)
    assert found[0].lcp == 0
    for x, y, r in zip(names, names[1:], found[1:]):
        assert r.lcp == lcp(x, y)
    # Sorted: what two suffixes share is the least of what the neighbours between them share.
    for i in range(0, len(names), 7):
        least = 10**9
        for j in range(i + 1, len(names)):
            least = min(least, found[j].lcp)
            assert lcp(names[i], names[j]) == least


def test_odd_rows(spark):
    rows = [(1, "a\nb"), (1, "a\nb"), (None, "a\nb\nc"), (None, None), (2, ""), (3, "a\nb\n" * 3000), (4, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_lines, r.n_removed) for r in ls.report_lines(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, 2, 2), (1, 2, 2), (None, 3, 0), (None, 0, 0), (2, 0, 0), (3, 6000, 6000), (4, 1, 0)], key=str)
    assert ls.report_lines(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ls.dedup_lines(docs, 3)
    assert ls.suffix_array(docs.limit(0)).count() == 0


def test_oracle(spark, tmp_path):
    rows = texts(random.Random(9), 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ls.ORACLE).fetchall()
    got = [tuple(r) for r in ls.query(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
