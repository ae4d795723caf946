import http.server
import itertools
import json
import os
import shutil
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from orebody.__main__ import arguments, main, settings
from orebody import workspace
from orebody.functions.text import words
from orebody.functions.vectors import cosine, normalised
from orebody.operators import cluster, reasoning, relations
from orebody.operators.anomalies import COLUMNS
from orebody.operators.cluster import centroids, dbscan, pca_reduce
from orebody.operators.components import connected_components
from orebody.operators.current import latest_rows
from orebody.operators.incremental import MerkleStore, _prefix, build_tree, changed_leaves, due_points, due_rows, with_leaf
from orebody.operators.reasoning import OfflineReasoner, conclusion
from orebody.operators.report import Report, export, finding_cluster, listed, search, with_places
from orebody.operators.sampling import diverse_sample, order_key, sample
from orebody.operators.taxonomy import classify
from orebody.plans.pipeline import analyse, run_once, watch
from orebody.sources import pages, payload
from orebody.sources.batches import RunBatches
from orebody.sources.settings import RunConfig, interval_seconds, load_env
from orebody.streaming.points import arrivals, deliveries, point_stream, run_on

POINTS = "id long, seq long, embedding array<float>, fragment string, source string, layer string, extra string"
STAMPS, RUNS = "id long, seq long, run_id string, attempt int", "run_id string, attempt int, status string"


def sequential_dbscan(x, eps, min_pts):
    """Labels by opening clusters in the order of rows."""
    near = [[j for j in range(len(x)) if j != i and 1 - x[i] @ x[j] <= eps] for i in range(len(x))]
    label, number = [None] * len(x), 0
    for i in range(len(x)):
        if label[i] is not None:
            continue
        if len(near[i]) < min_pts:
            label[i] = -1
            continue
        number += 1
        queue = [i]
        while queue:
            j = queue.pop(0)
            if label[j] in (None, -1):
                label[j] = number
                if len(near[j]) >= min_pts:
                    queue += near[j]
    return label


@pytest.mark.parametrize("eps,min_pts", [(0.05, 3), (0.15, 5), (1.2, 4)])
def test_dbscan_is_the_sequential_one(spark, eps, min_pts):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(12, 6)), 15, axis=0) + 0.25 * rng.normal(size=(180, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    found = {r.id: r.cluster_id for r in dbscan(df, eps, min_pts).collect()}
    assert [found[i] for i in range(180)] == sequential_dbscan(x, eps, min_pts)


@pytest.mark.parametrize("eps", [0.1, 0.3])
def test_edges_of_scattered_rows(spark, monkeypatch, eps):
    """Rows near to nothing aren't sent to most cells: stored vectors stay in proportion; all pairs are found."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 64))
    x[::10] = x[1::10] + 0.3 * x[::10]  # pairs among scattered rows
    x[:600] = np.repeat(x[:4], 150, axis=0) + 0.4 * x[:600]  # dense places
    x[600:610], x[610] = x[:10] * 2, 0
    x = x.astype(np.float32)
    stored = []
    keep = cluster.materialise

    def noted(df, name, **options):
        out = keep(df, name, **options)
        if "v" in out.columns:
            stored.append(out.count())
        return out

    monkeypatch.setattr(cluster, "materialise", noted)
    monkeypatch.setattr(cluster, "FAR_BLOCK", 2500, raising=False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    found = {(r.s, r.t): r.distance for r in cluster.epsilon_edges(df, eps).collect()}
    u = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-12)
    d = 1 - u @ u.T
    s, t = np.nonzero(np.triu(d <= eps, 1))
    assert set(found) == set(zip(s.tolist(), t.tolist()))
    assert np.allclose([found[p] for p in zip(s.tolist(), t.tolist())], np.clip(d[s, t], 0, 2), atol=1e-9)
    assert sum(stored) <= 2 * len(x)


def test_dbscan_of_nothing(spark):
    assert dbscan(spark.createDataFrame([], "id long, embedding array<double>")).count() == 0


def test_pca_keeps_the_leading_plane(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5)) * [5, 3, 0.1, 0.1, 0.1] + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    y = np.array([r.embedding for r in pca_reduce(df, 2).orderBy("id").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(y), np.abs(u[:, :2] * s[:2]), atol=1e-6)
    assert pca_reduce(df, 9) is df


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 1000 + i) for i in range(300)] + [(7, 7), (None, 3)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in found} == {**{i: 100 for i in range(100, 161)}, 5: 5, **{1000 + i: 5 for i in range(300)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), (None, [1.0])], "a array<double>, b array<double>")
    rows = df.select(cosine("a", "b").alias("c"), normalised("a").alias("n")).collect()
    assert [round(r.c, 9) for r in rows] == [1.0, 0, 0, 0] and rows[0].n == [0.6, 0.8] and rows[1].n == [0, 0]


def test_words():
    assert words("A­b-c_d​ Ünï 7x\t") == ["ab", "c", "d", "ünï", "7x"] and words(None) == words("") == []


def test_latest_rows_keeps_one_row_of_repeats(spark):
    df = spark.createDataFrame([(1, 5, "a", 1), (1, 5, "a", 1), (1, None, "b", 2), (None, 9, "c", 3)], "id long, seq long, v string, __rank int")
    assert [tuple(r) for r in latest_rows(df).collect()] == [(1, 5, "a", 1)]


def test_due_points_edges(spark):
    p = [(1, 1, [1.0], "a", None, "x", "e"), (1, 1, [1.0], "a", None, "x", "e"), (2, 2, [None], "a", "s", "x", ""), (2, 3, [], "a", "s", "x", ""), (3, 4, [1.0], None, "s", "x", None),
         (4, 5, [1.0], "", "s", "x", None), (4, 6, [1.0], None, "s", "x", None), (None, 7, None, None, None, None, None), (5, 8, [1.0], "a", "s", "x", "")]
    s = [(1, 1, "r", 1), (1, 1, "r", 1), (2, 2, "r", 1), (3, 4, "r", 2), (4, 5, "r", 1), (5, 8, None, 1), (9, 1, "r", 1)]
    runs = [("r", 1, " Succeeded "), ("r", 1, " Succeeded "), ("r", 2, "failed"), (None, 1, "succeeded"), ("r", 3, None)]
    frame = spark.createDataFrame
    due = due_points(frame(p, POINTS), frame(s, STAMPS), frame(runs, RUNS))
    assert sorted(r.id for r in due.collect()) == [2, 3, 4, 5]
    assert due_points(frame([], POINTS), frame(s, STAMPS), frame(runs, RUNS)).count() == 0
    assert sorted(r.id for r in due_points(frame(p, POINTS), frame([], STAMPS), frame([], RUNS)).collect()) == [1, 2, 3, 4, 5]


def test_due_rows_by_descent(spark):
    a = spark.range(5000).select("id", F.xxhash64("id").alias("h1"), F.lit(1).cast("long").alias("h2"))
    b = a.where("id % 7 <> 0").withColumn("h1", F.when(F.col("id") % 11 == 0, 0).otherwise(F.col("h1")))
    assert sorted(r.id for r in due_rows(a, b).collect()) == [i for i in range(5000) if i % 7 == 0 or i % 11 == 0]


def test_merkle_store_survives_a_failure(spark, tmp_path):
    store = MerkleStore(spark, f"file://{tmp_path}/m")
    df = spark.range(50).withColumn("v", F.lit("a"))
    with pytest.raises(ValueError):
        store.run(df, ["v"], lambda d: (_ for _ in ()).throw(ValueError()))
    assert store.run(df, ["v"], lambda d: d).count() == 50
    assert store.run(df, ["v"], lambda d: d).count() == 0
    changed = df.withColumn("v", F.when(F.col("id") == 3, "b").otherwise(F.col("v"))).unionByName(spark.range(50, 52).withColumn("v", F.lit("a")))
    assert sorted(r.id for r in store.run(changed, ["v"], lambda d: d).collect()) == [3, 50, 51]


def test_merkle_store_descends_the_published_tree(spark, tmp_path):
    """Saved digests of leaves whose published digests are equal aren't looked at."""
    store = MerkleStore(spark, f"file://{tmp_path}/m")
    df = spark.range(500).withColumn("v", F.lit("a"))
    store.run(df.where("id < 0"), ["v"], lambda d: d)
    assert store.run(df, ["v"], lambda d: d).count() == 500
    done = f"{store.versions()[2]}/digests"
    kept = spark.createDataFrame(spark.read.parquet(done).collect(), spark.read.parquet(done).schema)
    kept.withColumn("h1", F.lit(0).cast("long")).write.mode("overwrite").partitionBy("prefix").parquet(done)
    assert store.run(df, ["v"], lambda d: d).count() == 0
    more = df.unionByName(spark.range(500, 3000).withColumn("v", F.lit("a"))).where("id <> 7")
    assert sorted(r.id for r in store.run(more, ["v"], lambda d: d).collect()) == list(range(500, 3000))
    assert store.run(more.where("id > 9"), ["v"], lambda d: d).count() == 0


def test_merkle_store_reads_digests_of_changed_leaves_only(spark, tmp_path):
    """Digests stored under other leading bits may be gone; a pointer without content isn't a version."""
    store = MerkleStore(spark, f"file://{tmp_path}/m")
    df = spark.range(20_000).withColumn("v", F.lit("a"))
    store.run(df, ["v"], lambda d: d.select("id"))
    folder = store.versions()[1].removeprefix("file://")
    depth = spark.read.parquet(f"{folder}/tree").agg(F.max("level")).first()[0]
    keep = with_leaf(df, depth).where("id = 77").select(_prefix(depth)).first()[0]
    stored = [p for p in os.listdir(f"{folder}/digests") if p.startswith("prefix=")]
    assert len(stored) > 100
    for p in stored:
        if p != f"prefix={keep}":
            shutil.rmtree(f"{folder}/digests/{p}")
    (tmp_path / "m/published/2").write_text("")
    changed = df.withColumn("v", F.when(F.col("id") == 77, "b").otherwise(F.col("v")))
    assert [r.id for r in store.run(changed, ["v"], lambda d: d.select("id")).collect()] == [77]
    assert list(store.versions()) == [1, 3]


def test_two_runs_cannot_publish_one_version(spark, tmp_path):
    store = MerkleStore(spark, f"file://{tmp_path}/m")
    store._publish(1, "a")
    with pytest.raises(RuntimeError):
        store._publish(1, "b")
    assert store.versions() == {1: f"file://{tmp_path}/m/a"}


def test_descent_grows_with_depth_only(spark):
    rows = spark.range(1000).select("id", F.xxhash64("id").alias("h1"), F.lit(1).cast("long").alias("h2"))
    tree = build_tree(with_leaf(rows, 6), 6)
    plan = changed_leaves(tree, tree, 6)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") < 20


def test_components_over_many_files(spark):
    """Tasks that see only some of the edges agree in the end."""
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (350, 2))] + [(1000 + i, 1001 + i) for i in range(200)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == {v: root(v) for e in edges if e[0] != e[1] for v in e}


def test_dbscan_of_copies(spark):
    """Equal vectors count as many times as they occur; a null vector is noise."""
    x = [[1.0, 0.0]] * 4 + [[0.0, 1.0]] * 2 + [[0.1, 1.0], [-1.0, 0.0]]
    df = spark.createDataFrame([*enumerate(x), (8, None)], "id long, embedding array<double>")
    found = {r.id: (r.cluster_id, r.is_core) for r in dbscan(df, 0.01, 2).collect()}
    assert found == {**{i: (1, True) for i in range(4)}, 4: (2, True), 5: (2, True), 6: (2, True), 7: (-1, False), 8: (-1, False)}
    given = spark.createDataFrame([(0, 1, 0.0), (1, 2, 0.0)], "s long, t long, distance double")
    assert {r.id: (r.cluster_id, r.is_core) for r in dbscan(df.where("id < 4"), 0.01, 2, edges=given).collect()} == {0: (1, False), 1: (1, True), 2: (1, False), 3: (-1, False)}


def test_centroids_of_mixed_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0]), (1, None), (1, [None, 4.0]), (None, [1.0])], "cluster_id int, embedding array<double>")
    assert [tuple(r) for r in centroids(df).collect()] == [(1, [2.0, 3.0])]


def test_diverse_sample_is_farthest_first(spark):
    x = np.random.default_rng(2).normal(size=(40, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    order = [r.id for r in df.orderBy(order_key(), "id").collect()]
    taken = [order[0]]
    while len(taken) < 6:
        taken.append(max((i for i in order if i not in taken), key=lambda i: min(((x[i] - x[j]) ** 2).sum() for j in taken)))
    assert {r.id for r in diverse_sample(df, 6).collect()} == set(taken)
    assert sample(df, 0) is df and sample(df, 7, "unknown").count() == 7


def test_payloads(spark):
    rows = [("7", [1.0], None, ("", "f.txt", None, None, None, "calm", None, "t" * 600, None, None, None, None, None, None, None, None, None)),
            ("0123456789abcdef-0000", None, {"b": [2.0], "a": [4.0]}, ("s", None, None, None, "deep", None, "r", None, "sum", None, None, None, ["x", "", "y", "z", "w"], ["k"], None, None, None)),
            ("9", None, None, None)]
    found = payload.normalise_payload(spark.createDataFrame(rows, payload.PAYLOAD_SCHEMA), combine=True).orderBy("id").collect()
    assert len(found) == 2
    assert (int(found[0].id), found[0].source, found[0].layer, len(found[0].fragment)) == (7, "f.txt", "calm", 500)
    assert (int(found[1].id), found[1].embedding, found[1].fragment) == (0x0123456789ABCDEF, [3.0], "sum | x | y | z | Concepts: k")


def test_settings(tmp_path, monkeypatch):
    assert interval_seconds("1h30m") == 5400 and RunConfig(sample_size=10, strategy="diverse").pool_size() == 15
    for bad in ("", "5", "0s", "-1m"):
        with pytest.raises(ValueError):
            interval_seconds(bad)
    (tmp_path / "e").write_text("# c\nOREBODY_A='1'\nOREBODY_B=2\n")
    monkeypatch.setenv("OREBODY_B", "kept")
    monkeypatch.delenv("OREBODY_A", raising=False)
    assert load_env(str(tmp_path / "e")) == {"OREBODY_A": "1"}
    monkeypatch.delenv("OREBODY_A")
    assert payload.host("http://a.b:1/x") == payload.host("a.b:1") == "a.b"


def test_whole_analysis(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(3, 8)), 20, axis=0) + 0.05 * rng.normal(size=(60, 8))
    rows = [(i, i, v.tolist(), f"According to studies show {i}", "s" if i % 2 else None, "deep", "") for i, v in enumerate(x)]
    made = analyse(spark.createDataFrame(rows, POINTS), RunConfig(epsilon=0.1, min_pts=3, reasoner=OfflineReasoner()))
    made.write(f"file://{tmp_path}/r")
    back = Report.read(spark, f"file://{tmp_path}/r")
    clusters = back.tables["clusters"]
    assert sorted(r.size for r in clusters.collect()) == [20, 20, 20] and back.tables["anomalies"].columns == COLUMNS
    assert "# Findings of c" in back.markdown("c") and listed(clusters, "size").count() == 3
    assert search(clusters, back.tables["bridges"], back.tables["anomalies"], "cluster").count() >= 3
    name = export(clusters.select("cluster_id"), str(tmp_path / "x"), "clusters", "now")
    assert '"count": 3' in open(name).read()


def _run_folder(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(3, 8)), 20, axis=0) + 0.05 * rng.normal(size=(60, 8))
    rows = [(i, i, v.tolist(), f"Theorem and proof {i}", "s", "deep", "") for i, v in enumerate(x)]
    spark.createDataFrame(rows, POINTS).write.parquet(f"{tmp_path}/points")
    return RunConfig(source=f"{tmp_path}/points", output_dir=f"{tmp_path}/out", epsilon=0.1, min_pts=3, incremental=True, semantic_labels=True, reasoner=OfflineReasoner())


def test_incremental_runs(spark, tmp_path):
    """The second run has nothing to do; a point that comes later is taken by the third."""
    config = _run_folder(spark, tmp_path)
    first = run_once(spark, config)
    assert first.points == 60
    document = json.load(open(f"{first.report}/report.json"))
    assert document["summary"]["total_clusters"] == 3 == len(document["clusters"]) and all("Conclusion" in c["reasoning"] for c in document["clusters"])
    stored = spark.read.parquet(f"{tmp_path}/out/findings/findings")
    assert {"cluster_analysis", "moat_analysis"} & {r.type for r in stored.collect()} and stored.where("finding_id is null").count() == 0
    assert spark.read.parquet(f"{tmp_path}/out/findings/members").select("member_id").distinct().count() == 60
    assert run_once(spark, config).points == 0
    spark.createDataFrame([(99, 99, [1.0] * 8, "x", "s", "deep", "")], POINTS).write.mode("append").parquet(f"{tmp_path}/points")
    assert run_once(spark, config).points == 1


def test_watch_goes_on_after_a_failure():
    done, slept = [], []

    def job():
        done.append(1)
        if len(done) == 2:
            raise ValueError("once")

    assert watch(job, "5m", cycles=3, sleep=slept.append) == 2 and slept == [300, 300]
    assert watch(job, "1s", stopped=lambda: True) == 0


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    config = _run_folder(spark, tmp_path)
    monkeypatch.chdir(tmp_path)
    args = ["run", config.source, "--output", config.output_dir, "--epsilon", "0.1", "--min-cluster-size", "3", "--incremental", "--offline-reasoner", "--semantic-labels", "--watch", "250ms", "--cycles", "1", "--strategy", "diverse", "--sample", "50"]
    assert main(args) == 0
    said = capsys.readouterr().out
    assert "50 points analysed" in said and "## Moats" in said
    folder = next(f"{config.output_dir}/{f}" for f in os.listdir(config.output_dir) if f[:2] == "20")
    assert main(["query", folder, "--topic", "mathematics"]) == 0 and "mathematics" in capsys.readouterr().out
    assert main(["search", folder, "cluster"]) == 0 and '"kind":"cluster"' in capsys.readouterr().out
    assert main(["export", folder, "moats", "--folder", f"{tmp_path}/x"]) == 0
    name = capsys.readouterr().out.strip()
    assert json.load(open(name))["count"] == len(json.load(open(name))["items"])
    assert settings(arguments().parse_args(["run", "x", "--payload", "--vector-name", "a", "--vector-combine", "--strict", "--topology-cap", "7"])).topology_cap == 7
    with pytest.raises(ValueError):
        settings(arguments().parse_args(["run", "x", "--watch", "soon"]))


def test_points_from_pages(spark):
    """Pages over HTTP, one of which fails at first; the tasks read them."""
    points = [{"id": str(i), "dense": [float(i), 1.0], "data": [9.0], "payload": {"text": f"t{i}"}} for i in range(7)]
    failed = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            offset, limit = (int(self.path.split(f"{n}=")[1].split("&")[0]) for n in ("offset", "limit"))
            if offset == 3 and not failed:
                failed.append(1)
                return self.send_error(500)
            body = json.dumps(points[offset : offset + limit]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(pages.PageSource)
        url = f"http://127.0.0.1:{server.server_port}/?offset={{offset}}&limit={{limit}}"
        raw = pages.stored(spark.read.format("orebody_pages").options(url=url, total=7, page=3).load())
        found = payload.normalise_payload(raw).orderBy("id").collect()
        assert [(int(r.id), r.embedding, r.fragment) for r in found] == [(i, [float(i), 1.0], f"t{i}") for i in range(7)]
        gone = spark.read.format("orebody_pages").options(url="http://127.0.0.1:1/{offset}{limit}", total=3, page=3, strict="false", tries=1).load()
        assert gone.count() == 0
    finally:
        server.shutdown()


def test_ids_and_stored_fields(spark):
    df = spark.createDataFrame([("18446744073709551615",), ("99999999999999999999",), ("00000000000000000007",), (None,)], "id string")
    assert [str(r[0]) for r in df.select(payload.numeric_id()).collect()] == ["18446744073709551615", str(0x9999999999999999), "7", "0"]


def test_payload_lines_strict_and_not(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"id": "1", "vector": [1.0], "payload": {"text": "a"}}\n{"id": "2", \n')
    assert payload.read_payloads(spark, str(tmp_path / "p.json")).count() in (1, 2)
    assert payload.normalise_payload(payload.read_payloads(spark, str(tmp_path / "p.json"))).count() == 1
    with pytest.raises(Exception):
        payload.read_payloads(spark, str(tmp_path / "p.json"), strict=True).collect()


def test_classifier_without_text(spark):
    df = spark.createDataFrame([(1, None, "kept"), (2, "", "kept"), (3, "x" * 200_000 + " qualia", "kept")], "id long, text string, __judged string")
    rows = classify(df, "text").orderBy("id").collect()
    assert [(r.topic, r.mode, r.posture, round(r.confidence, 4), r["__judged"]) for r in rows] == [("general", "unknown", "unknown", 0, "kept")] * 2 + [("consciousness_philosophy", "unknown", "unknown", 0.3333, "kept")]


def test_pairs_of_clusters_in_blocks(spark, monkeypatch):
    """Every pair once over several blocks; vectors that are null, empty, all zero or of another length have similarity 0."""
    monkeypatch.setattr(relations, "BLOCK", 3)
    x = np.random.default_rng(6).normal(size=(9, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(20, None), (21, []), (22, [0.0] * 4), (23, [1.0]), (None, [1.0] * 4)]
    found = {(r.cluster_a, r.cluster_b): r.similarity for r in relations.cluster_pairs(spark.createDataFrame(rows, "cluster_id int, centroid array<double>")).collect()}
    ids = [*range(9), 20, 21, 22, 23]
    assert len(found) == len(ids) * (len(ids) - 1) // 2
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for (a, b), s in found.items():
        assert a < b and abs(s - (unit[a] @ unit[b] if b < 9 else 0)) < 1e-12
    assert relations.cluster_pairs(spark.createDataFrame([], "cluster_id int, centroid array<double>")).count() == 0


def test_snippets_in_slices(spark, monkeypatch):
    """Slices of three rows give what one slice gives."""
    rows = [(c, i, i * i % 97, f"text {i % 40}" if i % 9 else "N/A") for c in (1, 2) for i in range(90)] + [(3, 1, None, "x" * 300), (3, 2, 5, None)]
    df = spark.createDataFrame(rows, "cluster_id int, id long, seq long, fragment string")
    whole = {r.cluster_id: r.snippets for r in reasoning.snippets(df).collect()}
    monkeypatch.setattr(reasoning, "SLICE_ROWS", 3)
    assert {r.cluster_id: r.snippets for r in reasoning.snippets(df).collect()} == whole and whole[3] == ["x" * 200 + "..."] and len(whole[1]) == 8


def test_tables_of_a_job_are_released(spark):
    with workspace.released():
        path = workspace.materialise(spark.range(3), "kept").inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_places_of_a_sorted_table(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("id", "(id * 7919) % 1000 as v")
    found = {r.id: r.place for r in with_places(df.orderBy("v")).collect()}
    assert found == {i: (i * 7919) % 1000 + 1 for i in range(1000)}


def test_small_functions(spark):
    df = spark.createDataFrame([("Cluster 4: x", [9], "a **Conclusion:** **One** thing. Two."), ("Moat: 2 ↔ 3", [9], "no"), ("other", [9], "b. c"), ("other", [], "")], "subject string, clusters array<int>, chain string")
    rows = df.select(finding_cluster().alias("c"), conclusion("chain").alias("l")).collect()
    assert [r.c for r in rows] == [4, 2, 9, 0] and [r.l for r in rows] == ["One thing.", "no", "b.", ""]


def test_batches_of_a_run(spark, tmp_path):
    run = RunBatches(spark, "r1", f"file://{tmp_path}")
    run.store(0, spark.range(10))
    run.store(1, spark.range(10, 25))
    run.store(1, spark.range(10, 20))
    assert run.total() == 20 and run.sample(5).count() == 5
    run.delete()


def test_streams(spark, tmp_path):
    schema = "id long, seq long, source string, arrived_at timestamp"
    rows = spark.sql("select * from values (1L, 1L, ' A ', timestamp'2024-01-01 10:00:00'), (1L, 1L, ' A ', timestamp'2024-01-01 10:00:00'), (2L, 2L, null, timestamp'2024-01-09 10:00:00') as t(id, seq, source, arrived_at)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = point_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
    once = run_on(deliveries(stream), lambda d: d, f"{tmp_path}/out", f"{tmp_path}/c1")
    once.awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]
    again = run_on(deliveries(stream), lambda d: d, f"{tmp_path}/out", f"{tmp_path}/c1")
    again.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    counted = arrivals(stream).writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    counted.awaitTermination(60)
    assert sorted((r.source, r.n) for r in spark.table("counted").collect()) == [("a", 2), ("unknown", 1)]
    assert not list(itertools.islice(spark.streams.active, 1))
