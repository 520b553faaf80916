"""SimHash and license scans against plain versions."""

import hashlib
import random

import duckdb
import numpy as np

from quern.llm import license_scan, simhash
from quern.llm import queries as q


def edits(texts):
    for i, t in enumerate(texts):
        nxt, k = texts[(i + 1) % len(texts)], len(t) // 4
        yield t[: len(t) - k] + nxt[:k]


def check(rows, texts):
    for r, t, e in zip(rows, texts, edits(texts), strict=True):
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
    by_text = {}
    for r, t in zip(rows, texts, strict=True):
        assert by_text.setdefault(t, r.fp) == r.fp
    like = lambda a, b: 1 - bin((a ^ b) & (2**64 - 1)).count("1") / 64
    for i, r in enumerate(rows):
        assert r.near_edited == like(r.fp, r.edited_fp) and r.near_next == like(r.fp, rows[(i + 1) % len(rows)].fp)


def check_near(rows, fp):
    values = np.array([fp(r) & (2**64 - 1) for r in rows], np.uint64)
    for r, v in zip(rows, values, strict=True):
        want = int((np.bitwise_count(values ^ v) <= 3).sum()) - 1
        assert r.n_near == (want if r.doc_id is not None and r.doc_id % 50 == 0 else None)


def test_near_counts(spark, make):
    r = random.Random(6)
    base = " ".join(f"w{r.randint(0, 999)}" for _ in range(300))
    texts = [base] * 30 + [base.replace(" ", "  x ", k) for k in range(40)] + ["b c"] * 12 + [None, "", "other text"]
    ids = [50 * (i % 35) if i % 9 else None for i in range(len(texts))]
    rows = simhash.fingerprint_edits(spark, make(texts, ids)).collect()
    check_near(rows, lambda r: r.fp)
    assert max(r.n_near or 0 for r in rows) >= 29
    fps = spark.createDataFrame([(r.fp, 1) for r in rows], "fp long, n int")
    split = simhash.near_search(fps, fps, 3, 6, 2)
    whole = simhash.near_search(fps, fps, 3, 6)
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, whole.collect()))


def test_rows_without_ids(spark, make):
    texts = [f"text {i} of many" for i in range(120)] + ["same"] * 30
    rows = simhash.in_order(make(texts, [None] * 100 + list(range(50))), 10)
    sizes = {r.bucket: r["count"] for r in rows.where("doc_id is null").groupBy("bucket").count().collect()}
    assert sum(sizes.values()) == 100 and len(sizes) > 5 and max(sizes) < 0
    assert simhash.fingerprint_edits(spark, make(texts, [None] * 150)).count() == 150


def test_query(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    rows = q.QUERIES["op3_simhash"](spark, sf).orderBy("doc_id").collect()
    check([type("R", (), r.asDict() | {"fp": int(r.fingerprint, 16), "edited_fp": int(r.edited_fingerprint, 16)}) for r in rows], texts)
    check_near(rows, lambda r: int(r.fingerprint, 16))
    long = [r for r in rows if r.n_chars > 400]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.97


def test_edges(spark, make, edges, monkeypatch):
    ids = [3 * i - 20 for i in range(len(edges))]
    whole = simhash.in_order
    for per_bucket in (1, 4, 2000):
        monkeypatch.setattr(simhash, "in_order", lambda d, n=per_bucket: whole(d, n))
        rows = simhash.fingerprint_edits(spark, make(edges, ids)).orderBy("doc_id").collect()
        check(rows, [t or "" for t in edges])
    same = simhash.fingerprint_edits(spark, make(["b c", "a", "b c", None], [None, None, 5, 5])).collect()
    assert len(same) == 4 and sorted(r.n_chars for r in same) == [0, 1, 3, 3]
    assert len(simhash.fingerprint_edits(spark, make(["only one"])).collect()) == 1
    assert simhash.fingerprint_edits(spark, make([])).count() == 0


def test_votes_of_long_texts(spark, monkeypatch):
    df = spark.createDataFrame([(0, " ".join(f"w{i % 97}" for i in range(5000)))], "i int, text string")
    a = simhash.fingerprints(df, ["i"]).first().fp
    monkeypatch.setattr(simhash, "CHUNK", 333)
    assert simhash.fingerprints(df, ["i"]).first().fp == a


def test_near_pairs(spark):
    r = random.Random(8)
    values = [r.getrandbits(64) for _ in range(60)]
    for v in values[:40]:
        for _ in range(2):
            values.append(v ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))))
    values = [v - 2**64 if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "fp long")
    for radius, blocks in ((0, 1), (3, 6), (3, 4), (5, 7)):
        found = simhash.near_pairs(df, radius, blocks, 1000 if blocks == 6 else 3).collect()
        got = {(x.a, x.b, x.distance) for x in found}
        assert len(got) == len(found)
        d = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
        u = sorted(set(values))
        assert got == {(a, b, d(a, b)) for i, a in enumerate(u) for b in u[i + 1 :] if d(a, b) <= radius}


def test_license_scan(spark, make, edges):
    mit = license_scan.KNOWN["MIT"]
    texts = [*edges, mit, "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", " ,"), mit.replace("sublicense", "sub-licence"), mit + " more", "Licensed under the MIT Licence"]
    rows = license_scan.scan(make(texts), license_scan.known_table(spark)).orderBy("doc_id").collect()
    n = len(edges)
    assert [r.license_id for r in rows] == [None] * n + ["MIT", "MIT", "MIT", None, "MIT-notice"]
    assert license_scan.scan(make([]), license_scan.known_table(spark)).count() == 0
    assert license_scan.scan(make(texts), license_scan.known_table(spark, {"x": "..."})).where("license_id is not null").count() == 0


def test_full_license_texts(spark, make):
    import textwrap

    text = dict(license_scan.full_texts())
    file = lambda name: (license_scan.TEXTS / f"{name}.txt").read_text()
    isc = textwrap.fill(license_scan.KNOWN["ISC"], 76).replace("above copyright notice", "above\ncopyright notice")
    holder = "Copyright (c) 2020, The Somebody Project\nAll rights reserved.\n\n"
    bsd3 = file("BSD-3-Clause")
    cases = [
        ("MIT", "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + textwrap.fill(license_scan.KNOWN["MIT"], 78)),
        ("MIT", "The MIT License (MIT)\n\nCopyright 2019-2020 Somebody\n\n" + license_scan.KNOWN["MIT"]),
        ("ISC", "ISC License\n\nCopyright Somebody\n\n" + isc),
        ("BSD-3-Clause", "BSD 3-Clause License\n\n" + holder + bsd3),
        ("BSD-3-Clause", holder + textwrap.fill(bsd3.replace("the copyright holder nor", "Somebody, Inc. nor").replace("THE COPYRIGHT HOLDERS AND", "SOMEBODY AND"), 60)),
        ("BSD-3-Clause", holder + bsd3.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")),
        ("BSD-2-Clause", holder + file("BSD-2-Clause")),
        ("GPL-2.0", file("GPL-2.0").replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA")),
        ("Apache-2.0", file("Apache-2.0").split("   END OF TERMS")[0]),
        (None, file("Apache-2.0").replace("(c) You must retain", "(c) You need not retain")),
        (None, license_scan.KNOWN["MIT"] + "\ncopyright terms of another kind hold"),
        (None, "MIT License"),
    ]
    cases += [(name, file(name)) for name in text if (license_scan.TEXTS / f"{name}.txt").exists()]
    assert {"Apache-2.0", "MPL-2.0", "Unlicense", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "CC0-1.0"} <= set(text)
    rows = license_scan.scan(make([t for _, t in cases]), license_scan.known_table(spark)).orderBy("doc_id").collect()
    assert [r.license_id for r in rows] == [k for k, _ in cases]


def test_license_oracle(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(map(tuple, con.sql(q.ORACLE_SQL["op8_license_scan"]).fetchall()))
    assert sorted((r.doc_id, r.n_bytes, r.digest, r.license_id) for r in q.QUERIES["op8_license_scan"](spark, sf).collect()) == want
