import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from loomspark.llm import media, mixing, topk
from loomspark.llm.common import Scratch


def vectors(n=300, dim=20, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=dim).round(1)]) for i in range(n)]
    rows += [(n, None), (n + 1, [1.0, None] * (dim // 2)), (n + 2, [math.nan] * dim), (n + 3, [math.inf] + [0.0] * (dim - 1)), (None, [1.0] * dim), (n + 4, [0.5] * (dim + 2)), (7, rows[7][1]), (n + 5, [])]
    return rows


@pytest.mark.parametrize("cell_base,cell_queries", [(8192, 2048), (64, 3)])
def test_top_k_against_brute_force(spark, cell_base, cell_queries):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in topk.top_k(df, df.filter("vec_id % 50 = 0"), cell_base=cell_base, cell_queries=cell_queries).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {i: v for i, v in ok if i % 50 == 0}
    want = {}
    for q, qv in queries.items():
        scored = sorted(((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q and len(v) == len(qv)))[:5]
        if scored:
            want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert {q: sorted(v) for q, v in got.items()} == want


def test_top_k_huge_components_and_empty(spark):
    df = spark.createDataFrame([(0, [1e12, -1.0]), (1, [1e12, 2.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with_big = topk.top_k(df.filter("vec_id <> 1"), df.filter("vec_id = 0")).collect()
    assert [(r.vec_id, r.score) for r in with_big] == [(2, int(256e12) * 256 - 256 * 256)]
    with pytest.raises(Exception, match="doesn't fit a long"):
        topk.top_k(df, df.filter("vec_id = 0")).collect()
    # the same large components where the sum itself fits
    near = spark.createDataFrame([(0, [4e7, 4e7]), (1, [4e7, -4e7]), (2, [-4e7, 4e7]), (3, [4e7, 3e7])], "vec_id long, embedding array<double>").filter("vec_id < 3")
    assert [(r.vec_id, r.score) for r in topk.top_k(near, near.filter("vec_id = 0")).orderBy("rank").collect()] == [(1, 0), (2, 0)]
    with pytest.raises(Exception, match="too large in vector"):
        topk.top_k(spark.createDataFrame([(0, [1e17])], "vec_id long, embedding array<double>"), df).collect()
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_with_clashing_columns(spark):
    df = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(4)], "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS v", "3 AS grp", "4 AS score", "5 AS rank")
    got = topk.top_k(df, df.filter("vec_id = 0"), k=2).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in got] == [(1, 1, 65536), (2, 2, 65536)]


def brute_mix(rows, weights=(1, 2, 3), most=3):
    """Water-filling by rounds."""
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len((r[1] or "").split())
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, target, open_ = sum(size.values()), {}, set(names)
    left = total
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= most * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = most * size[s]
            open_.discard(s)
            left -= target[s]
    return size, target


def test_mix(spark, docs, hard_docs):
    plain = [r for r in hard_docs if r[1] is None or " " not in r[1]]
    df = docs.filter("doc_id IS NULL OR doc_id <> 19")
    got = mixing.mix_counts(df, block=16).collect()
    again = mixing.mix_counts(df.repartition(3), block=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    size, target = brute_mix(plain)
    assert len(got) == len(plain)
    assert {r.source_size for r in got} == set(size.values())
    for s, t in target.items():
        own = [r for r in got if r.source_size == size[s] and abs(r.target - t) < 1e-6 * max(1, t)]
        assert own and abs(sum(r.taken for r in own) - t) <= max(4, 0.02 * t)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)


def test_mixed_documents_hold_the_words_taken(spark, docs):
    df = docs.filter("doc_id IS NULL OR doc_id <> 19")
    taken = sum(r.taken for r in mixing.mix_counts(df, block=16).collect())
    clash = df.selectExpr("*", "1 AS uid", "2 AS size", "3 AS times", "4 AS m", "5 AS src")
    assert mixing.mix_documents(clash, block=16).columns == [*clash.columns, "slot"]
    rows = mixing.mix_documents(df, block=16).collect()
    assert sum(len(r.text.split()) for r in rows) == taken
    assert set(rows[0].asDict()) == {*docs.columns, "slot"} and all(r.n_chars == len(r.text) for r in rows)
    assert [r.slot for r in rows] == sorted(r.slot for r in rows)


def test_the_schedule_decides(spark, docs, monkeypatch):
    """Counts and order come from the slots: another schedule, another mix."""
    df = docs.filter("doc_id IS NULL OR doc_id <> 19")
    plain = sorted(map(str, mixing.mix_counts(df, block=16).collect()))
    made = mixing.schedule
    halved = lambda spark, shares, slots: made(spark, shares, slots).filter("rank < 5")
    monkeypatch.setattr(mixing, "schedule", halved)
    assert sorted(map(str, mixing.mix_counts(df, block=16).collect())) != plain
    back = lambda spark, shares, slots: made(spark, shares, slots).selectExpr("src", "rank", f"{slots} - 1 - slot AS slot")
    monkeypatch.setattr(mixing, "schedule", back)
    assert sorted(map(str, mixing.mix_counts(df, block=16).collect())) == plain
    turned = [r.doc_id for r in mixing.mix_documents(df, block=16).collect()]
    monkeypatch.setattr(mixing, "schedule", made)
    assert [r.doc_id for r in mixing.mix_documents(df, block=16).collect()] != turned


def test_cut_keeps_white_space(spark):
    text = " a  b\tc\n\nd  "
    df = spark.createDataFrame([(text, lo, hi, 4) for lo in range(4) for hi in range(lo + 1, 5)], "t string, lo long, hi long, size long")
    got = {(r.lo, r.hi): r.x for r in df.select("*", mixing._words_of("t", "lo", "hi", "size").alias("x")).collect()}
    assert got[0, 4] == text and all("".join(got[k, k + 1] for k in range(a, b)) == got[a, b] for a, b in got)
    assert got[1, 3] == "  b\tc" and got[3, 4] == "\n\nd  "


def test_schedule_is_even(spark):
    at = [int(mixing.PERIOD * x) for x in (0, 0.1, 0.3, 1)]
    shares = spark.createDataFrame([("a", at[0], at[1]), ("b", at[1], at[2]), ("c", at[2], at[3])], "src string, lo long, hi long")
    rows = mixing.schedule(spark, shares, 1000, chunk=64).collect()
    assert len(rows) == 1000
    for src, share in (("a", 0.1), ("b", 0.2), ("c", 0.7)):
        slots = sorted(r.slot for r in rows if r.src == src)
        assert [r.rank for r in sorted(rows, key=lambda r: r.slot) if r.src == src] == list(range(len(slots)))
        assert all(abs(sum(s < n for s in slots) - share * n) < 6 for n in range(0, 1001, 50))


def test_mix_empty(no_docs):
    assert mixing.mix_counts(no_docs).count() == 0 and mixing.mix_documents(no_docs).count() == 0


def test_media_round_trip(spark, docs, hard_docs):
    folder = f"{Scratch(spark, 'test').root}/media"
    rows = media.media_columns(docs, folder).collect()
    assert len(rows) == len(hard_docs) and all(r.error is None for r in rows)
    texts = sorted((str(r[0]), (r[1] or "").encode()) for r in hard_docs)
    got = sorted((str(r.doc_id), media.decode_png(bytes(r.media)).rstrip(b"\xff")) for r in rows)
    assert got == texts


def test_byte_ranges_meet_each_member_once(spark, docs, hard_docs):
    folder = f"{Scratch(spark, 'test').root}/media"
    media.write_archives(docs.selectExpr("doc_id AS id", "cast(text AS binary) AS data"), folder, "id", "data", archive_bytes=2000)
    rows = media.read_archives(spark, folder, range_bytes="700", batch_bytes="500").collect()
    assert len(rows) == len(hard_docs) and len({r.member for r in rows}) == len(rows)


def test_archives_of_lost_attempts_are_not_seen(spark, tmp_path):
    """A task that ran twice leaves archives that its result doesn't name."""
    df = spark.createDataFrame([(k, b"y" * 700) for k in range(4)], "id long, data binary").coalesce(1)
    assert media.write_archives(df, f"file://{tmp_path}/a", "id", "data", archive_bytes=900) == 4
    one = next((tmp_path / "a").glob("*.zip"))
    (tmp_path / "a" / "part-000000-0000-lost.zip").write_bytes(one.read_bytes())
    (tmp_path / "a" / "part-000009-0000-torn.zip").write_bytes(one.read_bytes()[:50])
    rows = media.read_archives(spark, f"file://{tmp_path}/a").collect()
    assert sorted(r.member.split("/")[1] for r in rows) == ["0", "1", "2", "3"] and all(r.error is None for r in rows)
    # a folder of foreign archives has no manifest
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "any.zip").write_bytes(one.read_bytes())
    assert media.read_archives(spark, f"file://{tmp_path}/b").count() == 4


def test_media_names_and_features(spark, docs):
    assert media.open_store("file:///tmp/x")[1] == "/tmp/x"
    clash = docs.filter("doc_id = 1").selectExpr("*", "1 AS archive", "2 AS member", "3 AS media", "4 AS name", "5 AS data")
    got = media.media_columns(clash, f"{Scratch(spark, 'test').root}/clash").select("doc_id", media.features_udf()("media").alias("f")).first()
    x = np.frombuffer(media.pad(clash.first().text.encode()), np.uint8).astype(float)
    hist = [int(((x // 16) == k).sum()) for k in range(16)]
    bits = "".join("1" if c.mean() > x.mean() else "0" for c in x.reshape(64, -1))
    want = f"mean={int(x.mean() * 256)};std={int(x.std() * 256)};hist={bytes(h * 255 // max(hist) for h in hist).hex()};hash={int(bits, 2):016x}"
    assert got.f.feature == want
    with pytest.raises(ValueError, match="not a PNG"):
        media.decode_png(b"GIF89a")


def test_a_bad_member_is_reported_and_others_stay(spark, tmp_path):
    df = spark.createDataFrame([(k, b"x" * 600 * k) for k in range(1, 4)], "id long, data binary").coalesce(1)
    media.write_archives(df, f"file://{tmp_path}", "id", "data")
    path = next(tmp_path.glob("*.zip"))
    data = bytearray(path.read_bytes())
    at = data.index(media.PNG_HEAD, data.index(media.PNG_HEAD) + 1)
    data[at + 40] ^= 255
    path.write_bytes(bytes(data))
    rows = media.read_archives(spark, f"file://{tmp_path}", tries="2").collect()
    assert sorted(r.error is None for r in rows) == [False, True, True]
    assert [r.media for r in rows if r.error] == [None]


def test_media_facts_and_empty(spark, no_docs):
    assert media.media_columns(no_docs, f"{Scratch(spark, 'test').root}/none").count() == 0
    p = media.pad(b"")
    assert len(p) == 576 and media.decode_png(media.encode_png(p)) == p
    df = spark.createDataFrame([(media.encode_png(media.pad("é".encode())),)], "m binary").select(media.features_udf()("m").alias("f")).select("f.*").first()
    q = media.pad("é".encode())
    assert (df.n_bytes, df.payload_bytes, df.payload_sha256, df.tail_crc32) == (2, 576, hashlib.sha256(q).hexdigest(), zlib.crc32(q[-32:]))
    random.seed(0)
    for n in (1, 575, 576, 577, 5000):
        b = random.randbytes(n).replace(b"\xff", b"a")
        assert media.decode_png(media.encode_png(media.pad(b))).rstrip(b"\xff") == b
