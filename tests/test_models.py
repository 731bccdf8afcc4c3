"""Similarity, profiles, ratings, graphs, clustering, sketches and streams on small frames."""

import hashlib
import math
import random
import socket
import statistics
import threading
import time
from collections import Counter, defaultdict
from datetime import timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from kilnwork.operators import cluster as K
from kilnwork.operators import graph as G
from kilnwork.operators import profiles as T
from kilnwork.operators import ratings as C
from kilnwork.operators import similarity as S
from kilnwork.operators import sketch as H
from kilnwork.plans import graphs as P
from kilnwork.plans import ratings as Q
from kilnwork.plans.catalogue import registry
from kilnwork.streaming import streams as X
from kilnwork.streaming.progress import Progress, timed


@pytest.fixture
def sets(spark):
    draw = random.Random(3)
    base = [draw.sample(range(60), 8) for _ in range(8)]
    data = {f"s{i}": {str(x if draw.random() < 0.85 else draw.randrange(60)) for x in base[i % 8]} for i in range(40)}
    return data, spark.createDataFrame([(k, t) for k, v in data.items() for t in v], "id string, token string")


def test_jaccard_pairs_and_banding(sets):
    data, df = sets
    brute = {(a, b): len(data[a] & data[b]) / len(data[a] | data[b]) for a, b in combinations(sorted(data), 2)}
    exact = {(r["id1"], r["id2"]): r["sim"] for r in S.jaccard_pairs(df, 0.5).collect()}
    assert exact == {p: s for p, s in brute.items() if s >= 0.5}
    found = S.candidates(S.signatures(df, 64), 2, 32)
    assert {(r["id1"], r["id2"]) for r in S.verified(found, df, 0.5).collect()} <= set(exact)
    measured = S.precision_recall(S.verified(found, df, 0.5), S.jaccard_pairs(df, 0.5)).first()
    assert measured["precision"] == 1.0 and measured["recall"] >= 0.95


def test_signatures_fall_under_union(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "2"), ("ab", "1"), ("ab", "2")], "id string, token string")
    sig = {r["id"]: r["sig"] for r in S.signatures(df, 8).collect()}
    assert sig["ab"] == [min(x, y) for x, y in zip(sig["a"], sig["b"], strict=True)]


def test_profiles(spark):
    df = spark.createDataFrame([("d1", "u1", "Red red apple"), ("d2", "u1", "apple\npie"), ("d3", "u2", None), ("", "u2", "x")], "doc string, user string, text string")
    stop = spark.createDataFrame([("pie",)], "value string")
    tf = T.term_counts(df, "doc", "text", stop)
    assert sorted(map(tuple, tf.collect())) == [("d1", "apple", 1), ("d1", "red", 2), ("d2", "applepie", 1)]
    features = T.feature_words(T.tfidf(tf, 3))
    profiles = T.document_profiles(tf, features)
    owners = T.owner_profiles(df, "user", "doc", profiles)
    pairs = spark.createDataFrame([("u1", "d1"), ("u2", "d1")], "owner string, doc string")
    assert [(r["owner"], r["sim"]) for r in T.cosine(pairs, owners, profiles).collect()] == [("u1", round(2 / math.sqrt(6), 6))]


def _pearson(x, y):
    mx, my = statistics.fmean(x), statistics.fmean(y)
    sx, sy = sum((a - mx) ** 2 for a in x), sum((b - my) ** 2 for b in y)
    return sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / math.sqrt(sx * sy) if sx and sy else 0.0


@pytest.fixture
def rated(spark):
    draw = random.Random(5)
    data = {(f"u{u}", f"b{b}"): float(draw.randint(1, 5)) for u in range(25) for b in draw.sample(range(15), 15 if u < 3 else 6)}
    data |= {("u30", f"b{b}"): 3.0 for b in range(15)}  # a constant rater
    df = spark.createDataFrame([(*k, v) for k, v in data.items()] + [("u1", None, 3.0), ("", "b1", 3.0), ("u1", "b99", None)], "user_id string, business_id string, stars double")
    return data, C.ratings(df)


def test_item_model_and_predictions(spark, rated):
    data, rows = rated
    by = defaultdict(dict)
    for (u, b), s in data.items():
        by[b][u] = s
    brute = {}
    for a, b in combinations(sorted(by), 2):
        both = sorted(set(by[a]) & set(by[b]))
        if len(both) >= 3 and (r := round(_pearson([by[a][u] for u in both], [by[b][u] for u in both]), 6)) > 0:
            brute[a, b] = r
    model = C.correlation_model(rows, "business", "user")
    assert {(r["a"], r["b"]): r["sim"] for r in model.collect()} == pytest.approx(brute)
    pairs = spark.createDataFrame([("u5", f"b{i}") for i in range(15)] + [("nobody", "b1")], "user string, business string")
    got = {(r["user"], r["business"]): r["stars"] for r in C.predictions(pairs, rows, model, "business", "user").collect()}
    sim = lambda a, b: brute.get((min(a, b), max(a, b)))
    for i in range(15):
        b = f"b{i}"
        if ("u5", b) in data:
            assert got["u5", b] == data["u5", b]
        else:
            near = sorted((-sim(b, o), o) for (u, o) in data if u == "u5" and sim(b, o))[:3]
            assert got.get(("u5", b)) == (pytest.approx(min(5, sum(-s * data["u5", o] for s, o in near) / sum(-s for s, _ in near)), abs=1e-4) if near else None)
    assert ("nobody", "b1") not in got


def test_user_model_holds_all_similar_pairs(spark, monkeypatch):
    """Users of 3 common businesses among 30 each (Jaccard 0.053), which 16 bands of 2 hardly ever meet."""
    draw = random.Random(6)
    data = {(f"u{u}", f"b{b}"): draw.randint(1, 5) for u in range(20) for b in [0, 1, 2, *range(100 + 27 * u, 127 + 27 * u)]}
    rows = C.ratings(spark.createDataFrame([(*k, float(v)) for k, v in data.items()], "user_id string, business_id string, stars double"))
    monkeypatch.setattr(Q, "_rows", lambda s, d: rows)
    brute = {}
    for a, b in combinations(sorted({u for u, _ in data}), 2):
        if (r := round(_pearson(*([data[u, f"b{i}"] for i in range(3)] for u in (a, b))), 6)) > 0:
            brute[a, b] = r
    got = {(r["a"], r["b"]): r["sim"] for r in registry().queries["cf_user_model"](spark, "").collect()}
    assert got == pytest.approx(brute)
    assert C.correlation_model(rows, "user", "business", similar=0.06).collect() == []


def test_hybrid_cold_start(spark, rated):
    data, rows = rated
    model = C.correlation_model(rows, "business", "user")
    users = C.correlation_model(rows, "user", "business")
    ua, ba = C.averages(rows, "user"), C.averages(rows, "business")
    refs = spark.createDataFrame([("u1", "u2", 1), ("u1", "gone", 2)], "user string, friend string, place int")
    pairs = spark.createDataFrame([("new", "b1"), ("u1", "new"), ("new", "new"), ("u1", "b1")], "user string, business string")
    got = {(r["user"], r["business"]): (r["seen"], r["stars"]) for r in C.hybrid(pairs, rows, model, users, ua, ba, refs).collect()}
    u = {r["user"]: r["avg"] for r in ua.collect()}
    b = {r["business"]: r["avg"] for r in ba.collect()}
    um, bm = statistics.fmean(u.values()), statistics.fmean(b.values())
    assert got["new", "b1"] == (False, pytest.approx(0.2 * um + 0.8 * b["b1"], abs=1e-4))
    assert got["u1", "new"] == (False, pytest.approx(0.8 * (u["u2"] + um) / 2 + 0.2 * bm, abs=1e-4))
    assert got["new", "new"] == (False, pytest.approx((um + bm) / 2, abs=1e-4))
    assert got["u1", "b1"][0] and 0 <= got["u1", "b1"][1] <= 5


BRIDGE = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "e"), ("d", "f"), ("e", "f")]


def test_graph_of_two_triangles(spark):
    edges = spark.createDataFrame(BRIDGE, "a string, b string")
    flow = {(r["a"], r["b"]): r["betweenness"] for r in G.betweenness(edges).collect()}
    assert flow["c", "d"] == 9.0
    assert flow == pytest.approx(G.local_betweenness({v: {y if x == v else x for x, y in BRIDGE if v in (x, y)} for v in "abcdef"}))
    parts = {r["id"]: r["component"] for r in G.girvan_newman(edges).collect()}
    assert parts == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "d"}
    assert {r["id"]: r["component"] for r in G.connected_components(edges).collect()} == dict.fromkeys("abcdef", "a")
    labels = {r["id"]: r["label"] for r in G.label_propagation(edges).collect()}
    assert set(labels) == set("abcdef")


def test_distributed_split_agrees_with_the_local_one(spark, monkeypatch):
    edges = spark.createDataFrame(BRIDGE, "a string, b string")
    local = sorted(map(tuple, G.girvan_newman(edges).collect()))
    monkeypatch.setattr(G, "LOCAL_WORK", 0)
    assert sorted(map(tuple, G.girvan_newman(edges).collect())) == local


def test_split_goes_on_until_no_edge_is_left(spark, monkeypatch):
    """The best partition of this graph comes with the seventh of nine removals."""
    ends = "ab am bc bd bf bk bn cg cj ck de dh dl fi fl kl".split()
    edges = spark.createDataFrame([tuple(e) for e in ends], "a string, b string")
    monkeypatch.setattr(P, "_edges", lambda s, d: edges)
    query = registry().queries["girvan_newman"]
    local = sorted(map(tuple, query(spark, "").collect()))
    monkeypatch.setattr(G, "LOCAL_WORK", 0)
    assert sorted(map(tuple, query(spark, "").collect())) == local


def test_split_of_a_larger_graph_shares_out_its_roots(spark, monkeypatch):
    """No round is written; components that are large, small, trees or hung with trees come out as in one task, and as by joins."""
    draw = random.Random(3)
    pairs = {tuple(sorted(draw.sample(range(10, 22), 2))) for _ in range(16)} | {(i, i + 20) for i in range(12, 20)} | {(32, 52), (52, 53), (60, 61), (61, 62), (70, 71)}
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "a string, b string")
    split = lambda: sorted(map(tuple, G.girvan_newman(edges).collect()))
    local = split()
    monkeypatch.setattr(G, "LOCAL_WORK", 0)
    for work in (0, 60, 10**9):
        with monkeypatch.context() as m:
            m.setattr(G, "betweenness", None)
            m.setattr(G, "SHARED_WORK", work)
            assert split() == local


def test_distributed_rounds_leave_no_tables_of_rounds_before(spark, monkeypatch, tmp_path):
    edges = spark.createDataFrame(BRIDGE, "a string, b string")
    local = sorted(map(tuple, G.girvan_newman(edges).collect()))
    monkeypatch.setattr(G, "LOCAL_WORK", 0)
    monkeypatch.setattr(G, "SPLIT_EDGES", 0)
    monkeypatch.setattr("kilnwork.sources.staging.shared_dir", lambda spark: str(tmp_path))
    assert sorted(map(tuple, G.girvan_newman(edges).collect())) == local
    names = [p.name.split("-")[0] for p in (tmp_path / "staged").iterdir()]
    assert names.count("parts") == 1 and not names.count("betweenness") and not names.count("components")


def test_shared_betweenness(spark):
    draw, near = random.Random(6), defaultdict(set)
    pairs = [(i, draw.randrange(i)) for i in range(1, 60)] + [draw.sample(range(25), 2) for _ in range(25)]
    for x, y in pairs:
        near[x].add(y)
        near[y].add(x)
    assert G.shared_betweenness(spark, near) == pytest.approx(G.local_betweenness(near))
    for tree in ({0: {1}, 1: {0}}, {0: {1}, 1: {0, 2}, 2: {1, 3}, 3: {2}}):
        assert G.shared_betweenness(spark, tree) == G.local_betweenness(tree)


def test_betweenness_of_a_held_graph_writes_no_levels(spark, monkeypatch):
    """Roots are shared out where the graph fits a task; the joins that larger graphs take give the same."""
    draw = random.Random(8)
    pairs = {tuple(sorted(draw.sample(range(10, 70), 2))) for _ in range(90)} | {(70, 71), (71, 72), (80, 81)}
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "a string, b string")
    values = lambda: {(r["a"], r["b"]): r["betweenness"] for r in G.betweenness(edges).collect()}
    with monkeypatch.context() as m:
        m.setattr(G, "levels", None)
        held = values()
    near = defaultdict(set)
    for a, b in pairs:
        near[f"n{a}"].add(f"n{b}")
        near[f"n{b}"].add(f"n{a}")
    assert held == pytest.approx(G.local_betweenness(near))
    monkeypatch.setattr(G, "HELD_EDGES", 0)
    assert values() == pytest.approx(held)


def test_betweenness_by_blocks():
    draw, near = random.Random(4), {}
    for _ in range(300):
        x, y = draw.sample(range(160), 2)
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    assert G.block_betweenness(near) == pytest.approx(G.local_betweenness(near))


def test_path_counts_split_credit(spark):
    chain = [("s", "a"), ("s", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "e"), ("s", "x"), ("x", "y"), ("y", "z"), ("z", "e")]
    edges = spark.createDataFrame([tuple(sorted(e)) for e in chain], "a string, b string")
    levels = {(r["root"], r["id"]): (r["dist"], r["paths"]) for r in G.levels(edges).collect()}
    assert levels["s", "e"] == (4, 3) and levels["s", "c"] == (2, 2)


def test_long_path_component(spark):
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(200)], "a string, b string")
    assert {r["component"] for r in G.connected_components(edges).collect()} == {"000"}


def test_empty_graph(spark):
    edges = spark.createDataFrame([], "a string, b string")
    assert G.girvan_newman(edges).collect() == [] and G.betweenness(edges).collect() == []


@pytest.fixture
def blobs(spark):
    draw = random.Random(9)
    rows = [(i, [10.0 * (i % 3) + draw.gauss(0, 0.3), draw.gauss(0, 0.3), 1.0], i // 60) for i in range(180)] + [(999, [500.0, 500.0, 1.0], 2)]
    return spark.createDataFrame(rows, "id long, features array<double>, chunk int")


def test_kmeans_finds_blobs(blobs):
    got = {r["id"]: r["cluster"] for r in K.kmeans(blobs.where("id < 999"), 3).collect()}
    assert all(got[i] == got[i % 3] for i in got) and len(set(got.values())) == 3


def test_chunked_clusters_keep_all_points(blobs):
    rounds, final = K.chunked_clusters(blobs, "chunk", 3)
    for r in rounds.collect():
        assert r["nof_point_discard"] + r["nof_point_compression"] + r["nof_point_retained"] == {1: 60, 2: 120, 3: 181}[r["round_id"]]
    got = {r["id"]: r["cluster"] for r in final.collect()}
    assert len(got) == 181 and got[999] == -1


def test_near_compression_clusters_merge(spark):
    """Centers at 0, 2, 4 and 20: with a reach of 1.5 * sqrt(2) the first three join through the middle one."""
    rows = [(10 * c + i, [x + d, 0.0], c) for c, x in enumerate([0.0, 2.0, 4.0, 20.0]) for i, d in enumerate([-0.1, 0.1])]
    table = K.sums(spark.createDataFrame(rows, "id long, features array<double>, cluster int"))
    assert {tuple(r) for r in K.merged(table, 1.5).collect()} == {(0, 0), (1, 0), (2, 0)}
    both = {r["cluster"]: (r["n"], r["total"]) for r in K.added(table, table).collect()}
    assert both[1] == (4, pytest.approx([8.0, 0.0])) and len(both) == 4


def test_outliers_of_the_first_chunk_are_clustered(spark):
    """Far pairs become compression clusters, a far single point is retained."""
    draw = random.Random(2)
    rows = [(i, [100.0 * (i % 2) + draw.gauss(0, 0.3), draw.gauss(0, 0.3)], 0) for i in range(60)]
    rows += [(-5, [5e3, 5e3], 0), (-4, [-5e3, 5e3], 0), (-3, [9e5, 9e5], 0), (-2, [5e3, 5001.0], 0), (-1, [-5e3, 5001.0], 0)]
    rounds, _ = K.chunked_clusters(spark.createDataFrame(rows, "id long, features array<double>, chunk int"), "chunk", 2)
    got = tuple(rounds.first())
    assert got[:3] == (1, 2, 60) and 1 <= got[3] <= 2 and got[4:] == (4, 1)


def test_bloom_has_no_false_negatives(spark):
    first = spark.createDataFrame([(f"city {i}",) for i in range(300)] + [("",), (None,), ("Phönix",)], "city string")
    bits, size = H.bloom_bits(first, "city")
    probe = spark.createDataFrame([(f"city {i}",) for i in range(3000)] + [("",), (None,), ("Phönix",)], "city string")
    got = {r["city"]: r["member"] for r in H.bloom_members(probe, "city", bits, size).collect()}
    assert all(got[f"city {i}"] for i in range(300)) and got["Phönix"] and not got[""]
    assert sum(got[f"city {i}"] for i in range(300, 3000)) < 2700 * 0.05


def test_dense_ranks_keep_ties(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 5), ("c", 4), ("d", 3), ("e", 2), ("z", 0)], "tag string, n long")
    assert sorted((r["tag"], r["rank"]) for r in H.top_dense(counts, "tag").collect()) == [("a", 1), ("b", 1), ("c", 2), ("d", 3)]


@pytest.fixture
def events(spark, tmp_path):
    df = spark.range(600).select("id", F.timestamp_seconds(F.col("id") * 40).alias("ts"), (F.col("id") * 7 % 83).cast("string").alias("user"))
    df.repartition(4).write.parquet(str(tmp_path / "events"))
    return str(tmp_path / "events")


def test_streams_agree_with_batch_on_closed_windows(spark, events):
    batch = spark.read.parquet(events)
    live = X.table_stream(spark, events)
    got = {r["start"]: tuple(r)[1:] for r in X.finished(X.window_estimates(live, "ts", F.col("user"), "30 minutes", "10 minutes", "10 minutes"), "w").collect()}
    exact = {r["start"]: (r["n"], r["users"]) for r in H.window_counts(batch, "ts", "user", "30 minutes", "10 minutes").collect()}
    sketch = {r["start"]: r["estimate"] for r in H.fm_estimate(H.fm_sketch(batch, "ts", F.col("user"), "30 minutes", "10 minutes")).collect()}
    end = batch.agg(F.max("ts")).first()[0] - timedelta(minutes=40)
    assert got == {s: (*exact[s], sketch[s]) for s in exact if s <= end} and len(got) > 30
    assert 0.25 < statistics.median(got[s][2] / got[s][1] for s in got) < 4  # powers of two, known to lean upwards


def test_reservoir_is_the_least_hashes_over_many_batches(spark, events):
    held = X.held_by(X.finished(X.reservoir(X.table_stream(spark, events, 1), "id", 50), "r"), 50).collect()
    want = sorted((str(i) for i in range(600)), key=lambda i: hashlib.md5(i.encode()).hexdigest())[:50]
    assert {r["item"] for r in held} == set(want) and len(held) == 50


def test_tag_snapshots_and_estimate_log(spark, events):
    live = lambda: X.table_stream(spark, events, 1)
    tag = F.when(F.col("id") % 2 == 0, F.concat(F.lit("t"), (F.col("id") % 6).cast("string")))
    out = X.written(lambda path: X.tag_snapshots(live(), "id", tag, path, size=20), spark, "tags")
    texts = {r["batch"]: r["value"] for r in spark.read.text(f"{out}/snapshots", wholetext=True).collect()}
    assert len(texts) == 4 and all(t.startswith("The number of tweets with tags from the beginning: 20\n") for t in texts.values())
    log = X.written(lambda path: X.estimate_log(live(), "ts", F.col("user"), "30 minutes", "10 minutes", "1 day", path), spark, "log")
    assert all(r["value"].startswith("Time,Ground Truth,Estimation") for r in spark.read.text(log, wholetext=True).collect())


def test_progress_is_logged(spark, events, caplog):
    listener = Progress()
    spark.streams.addListener(listener)
    try:
        with caplog.at_level("INFO", "kilnwork"), timed("a stream"):
            X.finished(X.table_stream(spark, events), "p")
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
            time.sleep(2)
    finally:
        spark.streams.removeListener(listener)
    assert "a stream: Duration" in caplog.text and "600 rows" in caplog.text


def test_stream_bloom(spark, events):
    bits, size = H.bloom_bits(spark.createDataFrame([("1",), ("2",)], "user string"), "user")
    got = X.finished(X.bloom_filtered(X.table_stream(spark, events), "user", bits, size), "b").select("user", "member").distinct().collect()
    assert {r["user"] for r in got if r["member"]} >= {"1", "2"}


def test_stream_bloom_with_a_large_filter(spark, events, monkeypatch):
    bits, size = H.bloom_bits(spark.createDataFrame([("1",), ("2",)], "user string"), "user")
    by_map = X.finished(X.bloom_filtered(X.table_stream(spark, events), "user", bits, size), "b").orderBy("id").collect()
    monkeypatch.setattr(X, "MOST_BITS", 1)
    assert X.finished(X.bloom_filtered(X.table_stream(spark, events), "user", bits, size), "b").orderBy("id").collect() == by_map


def test_socket_lines(spark, tmp_path):
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        peer, _ = server.accept()
        with peer:
            peer.sendall(b'{"city": "Baireville"}\n{"city": null}\nno json\n')
            time.sleep(20)

    threading.Thread(target=serve, daemon=True).start()
    rows = X.json_lines(X.socket_lines(spark, "127.0.0.1", server.getsockname()[1]), "city string")
    q = rows.writeStream.format("memory").queryName("socket_rows").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        until = time.time() + 60
        while spark.table("socket_rows").count() < 3 and time.time() < until:
            time.sleep(0.5)
    finally:
        q.stop()
        server.close()
    assert Counter(r["city"] for r in spark.table("socket_rows").collect()) == {"Baireville": 1, None: 2}


def test_tracked_statuses(spark):
    df = spark.createDataFrame([("I like Python", "en"), ("python", "fr"), ("snakes", "en")], "text string, lang string")
    assert [r["text"] for r in X.tracked(df, "text", "lang", ["python"], ["en"]).collect()] == ["I like Python"]
