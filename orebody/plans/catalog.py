"""Queries over the test tables, and their SQL where it can be said in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from orebody.functions.columns import layer_category, source_category, usable
from orebody.functions.vectors import coherence_band, link_type, normalised, unit_distance
from orebody.functions.vocabulary import DEFAULT, LABEL_KEYWORDS
from orebody.operators import anomalies, cluster, incremental, reasoning, relations, report, sampling, taxonomy
from orebody.operators.current import latest_rows
from orebody.sources import payload
from orebody.sources.batches import RunBatches
from orebody.sources.settings import interval_seconds
from orebody.streaming import points
from orebody.workspace import materialise, scratch

EPSILON = 0.1
SUPPORT = 0.39
ODD = (0.77, 0.62, 0.75)  # coherence, low and high density at which some of the test clusters are anomalies


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _points(spark, d):
    """Current points with source and layer as categories."""
    now = latest_rows(table(spark, d, "points"))
    return now.withColumns({"source": source_category(), "layer": layer_category()})


def _vectors(spark, d):
    return _points(spark, d).where(usable())


def _clusters(spark, d):
    return table(spark, d, "clusters").where("cluster_id is not null")


def _members(spark, d):
    """(cluster_id, id, ...): current points with usable vectors in the stored member lists, each id of a list once."""
    ids = _clusters(spark, d).select("cluster_id", F.explode(F.array_distinct("vector_ids")).alias("id"))
    return ids.join(_vectors(spark, d), "id")


def p4_found(spark, d):
    return incremental.due_points(table(spark, d, "points"), table(spark, d, "processed_points"), table(spark, d, "excavation_runs"))


def s_collection_size(spark, d):
    return _points(spark, d).agg(F.count("*").alias("points"), F.sum(usable().cast("long")).alias("usable"))


def s_extract(spark, d):
    """The first 500 points by id: a limit is the feature."""
    return _points(spark, d).orderBy("id").limit(500).select("id", "source", "layer", "fragment")


def s_unprocessed(spark, d):
    return payload.unprocessed(_points(spark, d), table(spark, d, "processed_points")).select("id")


def s_cut(spark, d):
    return _points(spark, d).select("id", payload.cut(F.col("fragment"), 120).alias("short"))


def _payloads(spark, d):
    """Points as raw payloads: ids as numbers or UUIDs, the vector under two names, texts in several fields."""
    now = _points(spark, d)
    uuid = F.concat(F.lpad(F.lower(F.hex("id")), 16, "0"), F.lit("-0000-0000"))
    none, texts = F.lit(None).cast("string"), F.array().cast("array<string>")
    odd = F.col("id") % 2 == 1
    fields = {"source": F.when(odd, F.col("source")), "source_file": F.when(F.col("id") % 4 == 0, F.concat("source", F.lit(".txt"))), "layer": F.when(odd, F.col("layer")), "tone": F.lit("calm"), "run_id": F.col("run_id"), "summary": F.when(odd, F.col("fragment")), "report": F.when(F.col("id") % 4 == 0, F.col("fragment")), "verdict": F.when(F.col("id") % 4 == 0, F.lit("kept")), "text": F.col("fragment"), "claims": F.when(odd, F.array(F.col("layer"), F.lit(""), F.col("source"))), "concepts": F.when(odd, F.array("layer"))}
    order = ("source", "source_file", "source_collection", "source_id", "layer", "tone", "run_id", "text", "summary", "canonical_statement", "report", "verdict", "claims", "concepts", "echoes", "questions", "tags")
    packed = F.struct(*[fields.get(n, texts if n in ("claims", "concepts", "echoes", "questions", "tags") else none).alias(n) for n in order])
    vectors = F.map_from_arrays(F.array(F.lit("b"), F.lit("a")), F.array("embedding", F.reverse("embedding")))
    return now.where("size(embedding) = 96").select(F.when(odd, uuid).otherwise(F.col("id").cast("string")).alias("id"), F.lit(None).cast("array<float>").alias("vector"), vectors.alias("named_vectors"), packed.alias("payload"))


def s_payload(spark, d):
    """Points made of raw payloads."""
    made = payload.normalise_payload(_payloads(spark, d))
    return made.select(F.col("id").cast("long").alias("id"), "fragment", "source", "layer", "run_id")


def s_mean_vector(spark, d):
    """The mean of each point's named vectors, added up over the points place by place."""
    made = payload.normalise_payload(_payloads(spark, d), combine=True)
    long = made.select(F.posexplode("embedding").alias("pos", "x")).where("not isnan(x) and x is not null").groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    return long.select(F.col("pos").cast("long").alias("pos"), F.round("mean", 4).alias("mean"))


def s_named_vector(spark, d):
    """The first numbers of the vectors chosen by name, in the dense field, and in the field of older stores."""
    raw = _payloads(spark, d)
    dense = raw.withColumns({"dense": F.when(F.col("id").like("%-%"), F.col("named_vectors")["b"]), "data": F.array(F.lit(7.0)).cast("array<float>")})
    by_name, by_field = (payload.normalise_payload(df, name).select(F.col("id").cast("long").alias("id"), F.col("embedding")[0].cast("double").alias(c)) for df, name, c in ((raw, "a", "named"), (dense, "", "stored")))
    return by_name.join(by_field, "id").select("id", F.round("named", 4).alias("named"), F.round("stored", 4).alias("stored"))


def s_ids(spark, d):
    """Ids in all forms as numbers."""
    forms = spark.createDataFrame([("7",), ("18446744073709551615",), ("18446744073709551616",), ("0123456789abcdef-0000",), ("ffffffff-ffff-ffff-0000",), ("x",), ("",)], "id string")
    return forms.select("id", payload.numeric_id().cast("string").alias("number"))


def s_hosts(spark, d):
    urls = ("http://a.b:6333/x", "a.b:6333", "https://c.d", "e")
    return spark.createDataFrame([(u, payload.host(u)) for u in urls], "url string, host string")


def s_centroid_sources(spark, d):
    """Mean of the centroids of each stored source, number by number."""
    long = cluster.centroids_long(_clusters(spark, d).where("source is not null"), "centroid", "source")
    return long.select("source", F.col("pos").cast("long").alias("pos"), (F.round("value", 5) + 0.0).alias("value"))


def s_stamped(spark, d):
    """Points stamped by two runs, the second of which was repeated."""
    path = scratch(spark, "stamps")
    now = _points(spark, d).select("id")
    for run, rows in (("r1", now.where("id % 2 = 0")), ("r2", now), ("r2", now.where("id % 3 = 0"))):
        payload.stamp(rows, path, run)
    return payload.ledger(spark, path).select("id", F.col("run_id").cast("string").alias("run_id"))


def s_batches(spark, d):
    """Two batches of a run, the second stored again: all rows, and the sample of them."""
    run, now = RunBatches(spark, scratch(spark, "run").rsplit("/", 1)[1]), _points(spark, d).select("id")
    run.store(0, now.where("id % 2 = 0"))
    run.store(1, now.where("id % 2 = 1"))
    run.store(1, now.where("id % 4 = 1"))
    return run.sample(300).select("id", F.lit(run.total()).cast("long").alias("total"))


def s_settings(spark, d):
    times = ("90s", "5m", "1h30m", "250ms")
    return spark.createDataFrame([(t, float(interval_seconds(t))) for t in times], "text string, seconds double")


def sample_dispatch(spark, d):
    """How many rows each strategy gives, by its name."""
    rows = materialise(_points(spark, d).select("id", "source"), "rows")
    out = [(n, s, sampling.sample(rows, s, n).count()) for n, s in (("random", 400), ("stratified", 400), ("proportional", 400), ("no such name", 7), ("random", 0))]
    return spark.createDataFrame(out, "strategy string, size int, rows long")


def sample_capped(spark, d):
    """A cap on what is clustered: chosen by hash, in the order of seq."""
    kept = sampling.capped(_points(spark, d).select("id", "seq"), 1000, "seq")
    return kept.select("id")


def sample_random(spark, d):
    return sampling.random_sample(_points(spark, d).select("id", "source"), 400)


def sample_stratified(spark, d):
    return sampling.stratified_sample(_points(spark, d).select("id", "source"), 400)


def sample_proportional(spark, d):
    return sampling.stratified_sample(_points(spark, d).select("id", "source"), 400, allocation="proportional")


def sample_temporal(spark, d):
    return sampling.temporal_sample(_points(spark, d).select("id", "arrived_at"), 5, "arrived_at").select("id")


def sample_diverse(spark, d):
    return sampling.diverse_sample(_vectors(spark, d).select("id", "embedding"), 100).select("id")


def v_pairs(spark, d):
    """Cosine of all pairs of centroids, and what it is called."""
    pairs = relations.cluster_pairs(_clusters(spark, d))
    return pairs.select("cluster_a", "cluster_b", F.round("similarity", 5).alias("similarity"), link_type("similarity").alias("link_type"))


def v_distances(spark, d):
    """Distance of unit vectors for all pairs of centroids, and of one to a vector of another length."""
    unit = _clusters(spark, d).select(F.col("cluster_id").alias("c"), normalised("centroid").alias("v"))
    a, b = (unit.select(F.col("c").alias(f"cluster_{x}"), F.col("v").alias(f"v{x}")) for x in "ab")
    pairs = a.join(b, (F.col("cluster_a") < F.col("cluster_b")) & (F.col("cluster_a") % 3 == F.col("cluster_b") % 3))
    return pairs.select("cluster_a", "cluster_b", F.round(unit_distance("va", "vb"), 5).alias("distance"), unit_distance("va", F.slice("vb", 1, 5)).alias("other_length"))


def v_normalised(spark, d):
    n = _vectors(spark, d).select("id", F.posexplode(normalised("embedding")).alias("pos", "x"))
    return n.groupBy("pos").agg(F.round(F.avg("x"), 5).alias("mean")).select(F.col("pos").cast("long").alias("pos"), "mean")


def c_dbscan(spark, d):
    return cluster.dbscan(_vectors(spark, d).select("id", "embedding"), EPSILON, 3)


def c_edges(spark, d):
    """All pairs within the radius."""
    found = cluster.epsilon_edges(_vectors(spark, d).select("id", "embedding"), EPSILON)
    return found.select("s", "t", F.round("distance", 5).alias("distance"))


def c_described(spark, d):
    """Clusters of the full vectors, described."""
    members = cluster.cluster_members(_vectors(spark, d).select("id", "embedding", "source", "layer"), EPSILON, 3, 0)
    found = cluster.describe_clusters(members)
    return found.select("cluster_id", "label", "source", "size", F.round("density", 4).alias("density"), F.round("coherence", 4).alias("coherence"))


def c_analysis(spark, d):
    """Reduce to 50 numbers, cluster and describe all current points; eigenvectors have no SQL."""
    members = cluster.cluster_members(_vectors(spark, d).select("id", "embedding", "source", "layer"), 0.15, 5)
    found = cluster.describe_clusters(members)
    return found.select("cluster_id", "label", "source", "size", F.round("density", 4).alias("density"), F.round("coherence", 4).alias("coherence"))


def c_centroids(spark, d):
    return cluster.centroids_long(_members(spark, d)).select("cluster_id", F.col("pos").cast("long").alias("pos"), (F.round("value", 5) + 0.0).alias("value"))


def c_coherence(spark, d):
    m = materialise(_members(spark, d).select("cluster_id", "id", "embedding"), "members")
    return cluster.statistics(m).select("cluster_id", "size", F.round("coherence", 5).alias("coherence"), F.round("density", 5).alias("density"), coherence_band("coherence").alias("band"))


def c_labels(spark, d):
    return cluster.dominant_label(_members(spark, d))


def b_bridges(spark, d):
    found = relations.bridges(relations.cluster_pairs(_clusters(spark, d)))
    return found.select("cluster_a", "cluster_b", F.round("strength", 5).alias("strength"), "link_type")


def b_moats(spark, d):
    found = relations.moats(relations.cluster_pairs(_clusters(spark, d)))
    return found.select("cluster_a", "cluster_b", F.round("distance", 5).alias("distance"))


def b_links(spark, d):
    pairs = table(spark, d, "bridges").select(F.least("cluster_a", "cluster_b").alias("cluster_a"), F.greatest("cluster_a", "cluster_b").alias("cluster_b")).distinct()
    found = relations.sample_links(pairs, _members(spark, d))
    return found.select("cluster_a", "cluster_b", "rank", F.round("similarity", 5).alias("similarity"))


def b_support(spark, d):
    return relations.with_support(table(spark, d, "bridges"), 0.7).groupBy("support").agg(F.count("*").alias("bridges"))


def b_crosscheck(spark, d):
    return relations.crosscheck(table(spark, d, "bridges"), 0.7)


def _linked(spark, d):
    """The bridges, and one without links."""
    none = "cluster_a, cluster_b, strength, link_type, label, cast(null as array<struct<chunk_a_id:bigint,chunk_b_id:bigint,similarity:double>>) as sample_links"
    rows = table(spark, d, "bridges")
    return rows.unionByName(rows.orderBy("cluster_a", "cluster_b").limit(1).selectExpr(*none.split(", ")[:5], none.split(", ")[5]))


def b_support_classes(spark, d):
    """Support at a threshold at which the bridges differ."""
    return relations.with_support(_linked(spark, d), SUPPORT).groupBy("support").agg(F.count("*").alias("bridges"))


def b_crosscheck_mixed(spark, d):
    found = relations.crosscheck(_linked(spark, d), SUPPORT)
    return found.select("total", "supported", "semantic_only", F.round("ratio", 6).alias("ratio"))


def b_strongest(spark, d):
    return relations.strongest(table(spark, d, "bridges").select("cluster_a", "cluster_b", "strength").distinct())


def b_widest(spark, d):
    return relations.widest(table(spark, d, "moats").select("cluster_a", "cluster_b", "distance").distinct())


def a_findings(spark, d):
    found = anomalies.all_findings(_clusters(spark, d), table(spark, d, "bridges"), materialise(_members(spark, d).select("cluster_id", "source"), "members"))
    return found.select("type", "cluster_id", "subject", F.round("measure", 5).alias("measure"), "detail", "requires_review")


def _odd_clusters(spark, d):
    """The clusters, and three whose taxonomy makes them summaries of a topic; the label of one doesn't name it."""
    rows = _clusters(spark, d)
    odd = spark.createDataFrame([(9001, "Quantum notes", "quantum_mechanics", ""), (9002, "Loose ends", "quantum_mechanics", ""), (9003, "History of didactic work", "history", "label says x, content is y")], "cluster_id int, label string, topic string, label_warning string")
    taxonomy_ = F.struct("topic", F.lit("meta_descriptive_summary").alias("mode"), F.lit("unknown").alias("epistemic_posture"), F.lit("x").alias("source_family"), F.lit(0.5).alias("confidence"), "label_warning", F.lit("").alias("semantic_concept"))
    extra = odd.select("cluster_id", "label", F.lit("x / y").alias("source"), F.lit(1).alias("size"), F.lit(0.99).alias("density"), F.lit(0.9).alias("coherence"), taxonomy_.cast(rows.schema["taxonomy"].dataType).alias("taxonomy"))
    return rows.select(*extra.columns).unionByName(extra)


def a_branches(spark, d):
    """All detectors, at thresholds that each of them meets."""
    found = anomalies.all_findings(_odd_clusters(spark, d), table(spark, d, "bridges"), materialise(_members(spark, d).select("cluster_id", "source"), "members"), *ODD)
    return found.select("type", "cluster_id", "subject", F.round("measure", 5).alias("measure"), "detail", "requires_review")


def a_scores(spark, d):
    """Scores of the findings at the same thresholds."""
    clusters = _odd_clusters(spark, d)
    found = anomalies.all_findings(clusters, table(spark, d, "bridges"), materialise(_members(spark, d).select("cluster_id", "source"), "members"), *ODD)
    scored = found.join(clusters.select("cluster_id", "coherence", "density"), "cluster_id")
    return scored.select("type", "cluster_id", F.round(anomalies.anomaly_score(), 5).alias("score"))


def t_documents(spark, d):
    found = taxonomy.classify(table(spark, d, "documents").select("doc_id", "text"), "text")
    return found.select("doc_id", "topic", "mode", "posture", F.round("confidence", 5).alias("confidence"))


def t_fragments(spark, d):
    found = taxonomy.classify(_points(spark, d).select("id", "fragment"), "fragment")
    return found.groupBy("topic", "mode", "posture").agg(F.count("*").alias("points"))


def t_clusters(spark, d):
    found = taxonomy.classify_clusters(_clusters(spark, d), _members(spark, d))
    return found.select("cluster_id", "taxonomy.topic", "taxonomy.mode", "taxonomy.epistemic_posture", "taxonomy.source_family", "taxonomy.label_warning")


def t_warnings(spark, d):
    """What a label says about its content, for labels and contents that agree, contradict, or say nothing."""
    rows = [("deep / quantum notes", "quantum_mechanics", "scholarly_annotation"), ("Didactic notes", "history", "scholarly_annotation"), ("didactic notes", "history", "didactic_teaching"), ("ancient empire", "biology", "unknown"), ("ancient cell", "biology", "unknown"), ("theorem", "", "unknown"), ("theorem", "general", "unknown"), (None, "biology", "unknown"), ("plain", "biology", "unknown")]
    df = spark.createDataFrame(rows, "label string, topic string, mode string")
    return df.select("label", "topic", "mode", taxonomy.label_warning("label").alias("warning"), taxonomy.label_names_topic(F.lower("label"), F.col("topic")).alias("names_topic"))


def t_vocabularies(spark, d):
    """The names an axis and an anomaly can have."""
    rows = [(k, n) for k, names in (("mode", taxonomy.MODES), ("posture", taxonomy.POSTURES), ("anomaly", taxonomy.ANOMALIES)) for n in names]
    return spark.createDataFrame(rows, "kind string, name string")


def t_query(spark, d):
    return _clusters(spark, d).where(taxonomy.matches(mode="Scholarly_Annotation") | taxonomy.matches(mismatch=True)).select("cluster_id")


def t_families(spark, d):
    return _clusters(spark, d).select("cluster_id", taxonomy.source_family("label").alias("family"))


def q_search(spark, d):
    clusters, bridges = _clusters(spark, d), table(spark, d, "bridges")
    return report.search(clusters, bridges, anomalies.orphans(clusters, bridges), "SURFACE").select("kind", "title")


def q_listed(spark, d):
    """Clusters with an unusual density, and the place of each in the list."""
    clusters = _clusters(spark, d)
    found = report.with_places(report.listed(clusters, "density", False, anomalies.unusual_density(clusters, *ODD[1:3])))
    return found.select("place", "cluster_id", "density")


def _told(spark, d):
    """Clusters, bridges, moats, and the offline reasoner's findings about them with those of the detectors."""
    clusters, bridges, moats = _clusters(spark, d), table(spark, d, "bridges").dropDuplicates(["cluster_a", "cluster_b"]), table(spark, d, "moats").dropDuplicates(["cluster_a", "cluster_b"])
    members = materialise(_members(spark, d).select("cluster_id", "id", "seq", "fragment", "source"), "members")
    told = reasoning.findings(clusters, bridges, moats, members, reasoning.OfflineReasoner(), low_coherence=ODD[0])
    odd = anomalies.as_findings(anomalies.orphans(clusters, bridges))
    return clusters, bridges, moats, members, materialise(told.unionByName(odd), "told")


def r_findings(spark, d):
    """What the reasoner was asked about, and what of it is an anomaly."""
    found = _told(spark, d)[4]
    return found.select("type", "subject", "confidence", "is_anomaly", F.array_join(F.col("clusters").cast("array<string>"), ",").alias("clusters"), (F.length("reasoning_chain") > 0).alias("told"))


def q_reasoned(spark, d):
    """Clusters of the joined report: whether they were reasoned about, and are or have anomalies."""
    clusters, _, _, _, findings = _told(spark, d)
    return report.with_reasoning(clusters, findings).select("cluster_id", F.contains("reasoning", F.lit(reasoning.MARK)).alias("reasoned"), "is_anomaly", "has_anomaly")


def q_pairs_reasoned(spark, d):
    """Bridges and moats of the joined report: whether they were reasoned about."""
    _, bridges, moats, _, findings = _told(spark, d)
    both = [report.pairs_with_reasoning(df, findings, f"{kind}_analysis").select(F.lit(kind).alias("kind"), "cluster_a", "cluster_b", (F.col("reasoning") != "").alias("reasoned")) for kind, df in (("bridge", bridges), ("moat", moats))]
    return both[0].unionByName(both[1])


def q_anomalies(spark, d):
    """Anomalies of the joined report with the cluster each is about."""
    return report.projected_anomalies(_told(spark, d)[4]).select("type", "subject", "cluster_id")


def q_document(spark, d):
    """Totals and entries of the report, written as one JSON document and read back."""
    clusters, bridges, moats, _, findings = _told(spark, d)
    made = report.Report(findings=findings, clusters=clusters.drop("centroid", "vector_ids"), bridges=bridges, moats=moats, anomalies=findings)
    path = made.write_json(f"{scratch(spark, 'document')}/report.json", "points", "now")
    back = spark.read.option("multiLine", True).json(path)
    entries = [F.struct(F.lit(n).alias("name"), F.col(f"summary.total_{n}").cast("long").alias("total"), F.size(n).cast("long").alias("entries")) for n in report.Report.TABLES]
    return back.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def q_markdown(spark, d):
    """Lines of each kind in the report in words."""
    clusters, bridges, moats, _, findings = _told(spark, d)
    made = report.Report(findings=findings, clusters=clusters, bridges=bridges, moats=moats, anomalies=findings)
    text = spark.createDataFrame([(line,) for line in made.markdown("points").splitlines()], "line string")
    kind = F.when(F.col("line").startswith("- **"), "cluster").when(F.col("line").rlike("^- [0-9]+ ↔ [0-9]+: [0-9.]+ \\("), "bridge").when(F.col("line").rlike("^- [0-9]+ ↔ [0-9]+: [0-9.]+$"), "moat").when(F.col("line").rlike("^- [a-z_]+: cluster "), "anomaly")
    return text.select(kind.alias("kind")).where("kind is not null").groupBy("kind").agg(F.count("*").alias("lines"))


def q_stored(spark, d):
    """Findings stored by a run that was repeated, with their members."""
    _, _, _, members, findings = _told(spark, d)
    path = scratch(spark, "findings")
    for _ in range(2):
        report.store_findings(findings, path, "r1", members)
    stored, own = (spark.read.parquet(f"{path}/{n}") for n in ("findings", "members"))
    return stored.join(own.groupBy("finding_id").agg(F.count("*").alias("members")), "finding_id", "left").select("type", "subject", "clusters_text", F.coalesce("members", F.lit(0)).alias("members"))


def q_read_back(spark, d):
    """Rows of a report's tables after it was written and read."""
    clusters, bridges, moats = _clusters(spark, d), table(spark, d, "bridges"), table(spark, d, "moats")
    folder = report.Report(clusters=clusters, bridges=bridges, moats=moats, anomalies=anomalies.orphans(clusters, bridges)).write(scratch(spark, "report"))
    back = report.Report.read(spark, folder)
    return report.summary(**back.tables)


def q_export(spark, d):
    """The whole list of moats, exported and read back."""
    path = report.export(table(spark, d, "moats"), scratch(spark, "export"), "moats", "now")
    back = spark.read.option("multiLine", True).json(path)
    return back.select("kind", F.col("count"), F.explode("items").alias("m")).select("kind", "count", F.col("m.cluster_a").cast("int").alias("cluster_a"), F.col("m.cluster_b").cast("int").alias("cluster_b"))


def q_subjects(spark, d):
    """Clusters named by subjects, and the one a finding is about."""
    rows = [("Cluster 4: x", [9]), ("Bridge: 2 ↔ 3", [9]), ("Moat: 5 ⊥ 6", []), ("Moat: 5 ↔ 6", [7]), ("Cluster x: 4", [8]), ("", [])]
    df = spark.createDataFrame(rows, "subject string, clusters array<int>")
    return df.select("subject", F.array_join(report.subject_clusters().cast("array<string>"), ",").alias("named"), report.finding_cluster().alias("about"))


def q_titles(spark, d):
    return report.titled(table(spark, d, "moats").select("cluster_a", "distance"), _clusters(spark, d), "cluster_a")


def q_summary(spark, d):
    clusters = _clusters(spark, d)
    return report.summary(clusters, table(spark, d, "bridges"), table(spark, d, "moats"), anomalies.low_coherence(clusters))


def q_finding_members(spark, d):
    found = anomalies.low_coherence(_clusters(spark, d), ODD[0]).select(F.concat_ws("-", "type", "cluster_id").alias("finding_id"), "type", F.array("cluster_id").alias("clusters"))
    return report.finding_members(found, _members(spark, d))


def r_snippets(spark, d):
    found = reasoning.snippets(_members(spark, d))
    return found.select("cluster_id", F.posexplode("snippets").alias("pos", "snippet"))


def r_prompts(spark, d):
    return reasoning.bridge_prompts(table(spark, d, "bridges")).select("cluster_a", "cluster_b", "prompt")


def r_conclusions(spark, d):
    """The offline reasoner's conclusions about the strongest bridges."""
    chains = reasoning.reasoned(reasoning.bridge_prompts(relations.strongest(table(spark, d, "bridges"))), reasoning.OfflineReasoner())
    return chains.select("cluster_a", "cluster_b", reasoning.conclusion("reasoning_chain").alias("conclusion"))


def r_label_prompts(spark, d):
    return reasoning.label_prompts(_clusters(spark, d), _members(spark, d))


def r_named(spark, d):
    """Labels by a reasoner that answers in quotes, with an explanation, or not at all."""
    return reasoning.named(_clusters(spark, d), _members(spark, d), ShortReasoner()).select("cluster_id", "label")


class ShortReasoner:
    """Names a text by its number of words; of texts with an odd number there is no answer."""

    def answer(self, prompt: str) -> str:
        n = len(prompt.split(" "))
        if n % 2:
            raise ValueError("no answer")
        return f"\"{n} words\"\nbecause they were counted"


def r_promoted(spark, d):
    """Labels and sources of clusters, and labels of bridges, after the conclusions about them became labels."""
    clusters, bridges, _, _, findings = _told(spark, d)
    ends = findings.withColumns({"cluster_id": F.col("clusters")[0], "cluster_a": F.col("clusters")[0], "cluster_b": F.try_element_at("clusters", F.lit(2))})
    named = reasoning.promote_clusters(clusters.where("cluster_id <= 10"), ends.where("type = 'cluster_analysis' and cluster_id % 2 = 0")).select(F.lit("cluster").alias("kind"), "cluster_id", "source", F.substring("label", 1, 10).alias("label"))
    pairs = reasoning.promote_bridges(bridges, ends.where("type = 'bridge_analysis'")).select(F.lit("bridge").alias("kind"), F.col("cluster_a").alias("cluster_id"), F.col("cluster_b").cast("string").alias("source"), F.substring("label", 1, 10).alias("label"))
    return named.unionByName(pairs)


def w_deliveries(spark, d):
    """Points taken as a stream, each delivery once; the stream is run again on the same checkpoint and adds nothing."""
    at = scratch(spark, "stream")
    rows = table(spark, d, "points").select("id", "seq", "source", F.col("arrived_at").cast("timestamp").alias("arrived_at"))
    rows.repartition(4).write.parquet(f"{at}/in")
    stream = points.point_stream(spark, f"{at}/in", rows.schema)
    for _ in range(2):
        points.run_on(points.deliveries(stream, "10000 days"), lambda batch: batch.select("id", "seq"), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema("id long, seq long, batch int").parquet(f"{at}/out").select("id", "seq")


def w_incremental(spark, d):
    """Points two incremental runs take: all, then those that came or changed since the first."""
    store = incremental.MerkleStore(spark, scratch(spark, "store"))
    fields, now = ["embedding", "fragment", "source", "layer"], latest_rows(table(spark, d, "points")).select("id", "embedding", "fragment", "source", "layer")
    before = now.where("id % 7 <> 0").withColumn("fragment", F.when(F.col("id") % 11 == 0, F.concat("fragment", F.lit("!"))).otherwise(F.col("fragment")))
    runs = [store.run(df, fields, lambda due: due.select("id")) for df in (before, now, now)]
    return runs[0].withColumn("run", F.lit(1)).unionByName(runs[1].withColumn("run", F.lit(2))).unionByName(runs[2].withColumn("run", F.lit(3)))


QUERIES = {
    f.__name__: f
    for f in (
        p4_found, s_collection_size, s_extract, s_unprocessed, s_stamped, s_batches, s_settings, s_cut, s_payload, s_mean_vector, s_named_vector, s_ids, s_hosts, s_centroid_sources,
        sample_random, sample_stratified, sample_proportional, sample_temporal, sample_diverse, sample_dispatch, sample_capped,
        v_pairs, v_distances, v_normalised, c_edges, c_dbscan, c_described, c_analysis, c_centroids, c_coherence, c_labels,
        b_bridges, b_moats, b_links, b_support, b_support_classes, b_crosscheck, b_crosscheck_mixed, b_strongest, b_widest,
        a_findings, a_branches, a_scores, t_documents, t_fragments, t_clusters, t_warnings, t_vocabularies, t_query, t_families,
        q_search, q_listed, q_titles, q_summary, q_finding_members, q_reasoned, q_pairs_reasoned, q_anomalies, q_document, q_markdown, q_stored, q_read_back, q_export, q_subjects,
        r_snippets, r_prompts, r_conclusions, r_findings, r_label_prompts, r_named, r_promoted, w_deliveries, w_incremental,
    )
}

# SQL in pieces

_CATEGORY = "case when {0} is null or trim({0}) = '' then '{1}' else lower(trim({0})) end"
_ROWS = f"""select * replace ({_CATEGORY.format('source', 'unknown')} as source, {_CATEGORY.format('layer', 'surface')} as layer)
from (select *, row_number() over (partition by id order by seq desc) as rn from points where id is not null) where rn = 1"""
_DOT = "list_inner_product({0}::double[], {1}::double[])"
_USABLE = f"len(embedding) = 96 and {_DOT.format('embedding', 'embedding')} > 0"
_COSINE = f"{_DOT.format('{0}', '{1}')} / (sqrt({_DOT.format('{0}', '{0}')}) * sqrt({_DOT.format('{1}', '{1}')}))"
_MEMBERS = f"select i.cluster_id, c.* from (select distinct cluster_id, unnest(vector_ids) as id from clusters where cluster_id is not null) i join ({_ROWS}) c on i.id = c.id where {_USABLE}"
_PAIRS = f"select a.cluster_id as cluster_a, b.cluster_id as cluster_b, {_COSINE.format('a.centroid', 'b.centroid')} as similarity from clusters a, clusters b where a.cluster_id < b.cluster_id"
_LINK = "case when {0} > 0.7 then 'strong_semantic' when {0} > 0.5 then 'moderate_bridge' when {0} > 0.3 then 'weak_connection' else 'isolated' end"
_LONG = "select cluster_id, id, embedding, unnest(embedding)::double as x, unnest(range(0, 96)) as pos from m"
_CENTROIDS = f"select cluster_id, list(value order by pos) as centroid from (select cluster_id, pos, avg(x) as value from ({_LONG}) group by all) group by cluster_id"
_HITS = "len(list_filter(sample_links, lambda l: l.similarity >= 0.7))"
_SOME = _HITS.replace("0.7", str(SUPPORT))
_LINKED = "(select sample_links from bridges union all (select null from bridges limit 1))"
_SUPPORT = "case when sample_links is null or len(sample_links) = 0 then 'no_chunk_evidence' when {0} = 0 then 'semantic_only' when {0} = 1 then 'weak_topological' when {0} <= 3 then 'moderate_topological' else 'strong_topological' end as support"
_CHECK = "count(*) as total, coalesce(sum(case when {0} > 0 then 1 else 0 end), 0)::bigint as supported, coalesce(sum(case when {0} > 0 then 0 else 1 end), 0)::bigint as semantic_only"
_UNIT = f"select id, embedding::double[] as e, sqrt({_DOT.format('embedding', 'embedding')}) as m, source, layer, embedding from ({_ROWS}) where {_USABLE}"
_EDGES = f"select a.id as x, b.id as y, 1 - {_DOT.format('a.e', 'b.e')} / (a.m * b.m) as distance from v a, v b where a.id <> b.id and 1 - {_DOT.format('a.e', 'b.e')} / (a.m * b.m) <= {EPSILON}"
_DBSCAN = f"""with recursive v as ({_UNIT}), e as ({_EDGES}), core as (select x from e group by x having count(*) >= 3),
inner_ as (select x, y from e where x in (select x from core) and y in (select x from core)),
walk(id, other) as (select x, x from core union select w.id, i.y from walk w join inner_ i on w.other = i.x),
root as (select id, min(other) as root from walk group by id),
ranked as (select id, dense_rank() over (order by root)::int as cluster_id from root),
border as (select e.x as id, min(r.cluster_id) as cluster_id from e join ranked r on e.y = r.id where e.x not in (select x from core) group by e.x),
labels as (select v.id, coalesce(r.cluster_id, b.cluster_id, -1) as cluster_id, r.id is not null as is_core from v left join ranked r using (id) left join border b on b.id = v.id)"""
_CUT = "case when length({0}) > {1} then substr({0}, 1, {1} - 3) || '...' else {0} end"
_TEXTS = f"select cluster_id, id, seq, fragment from ({_MEMBERS}) where fragment is not null and fragment not in ('', 'N/A')"
_SOURCES = f"select cluster_id, source, count(*) as n from ({_MEMBERS}) group by all"


def _order(seed: int = 42) -> str:
    return f"md5('{seed}:' || id), id"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _warning(label: str, topic: str, mode: str) -> str:
    """SQL of ``label_warning``."""
    lower = f"lower(coalesce({label}, ''))"
    has = lambda w: f"contains({lower}, {_quoted(w)})"
    own = " or ".join(f"({topic} = '{t}' and ({' or '.join(map(has, ws))}))" for t, ws in LABEL_KEYWORDS.items())
    foreign = ", ".join(f"case when {topic} <> '{t}' and {has(w)} then {_quoted(w)} end" for t in sorted(LABEL_KEYWORDS) for w in LABEL_KEYWORDS[t])
    return f"""case when {has('didactic')} and {mode} not in ('didactic_teaching', 'unknown') then 'didactic label over content in mode ' || {mode}
when {topic} is null or {topic} in ('', 'general') or contains({lower}, split_part({topic}, '_', 1)) or {own} then ''
when coalesce({foreign}) is not null then 'label says ' || coalesce({foreign}) || ', content is ' || {topic} else '' end"""


def _anomalies(clusters: str, coherence: float, low: float, high: float) -> str:
    """SQL of all detectors over (cluster_id, label, coherence, density, topic, mode, label_warning)."""
    return f"""
with c as ({clusters}), s as ({_SOURCES}),
k as (select cluster_id, count(*) as k, max(n) / sum(n) as top, max_by(source, (n, source)) as s, string_agg(source, ', ' order by source) as names from s group by cluster_id),
f as (select 'coherence_anomaly' as type, cluster_id, label, coherence as measure, '' as detail, false as review from c where coherence < {coherence}
union all select 'density_anomaly', cluster_id, label, density, case when density < {low} then 'low' else 'high' end, false from c where density < {low} or density > {high}
union all select 'orphan_cluster', cluster_id, label, null, '', false from c where cluster_id not in (select cluster_a from bridges where cluster_a is not null union select cluster_b from bridges where cluster_b is not null)
union all select 'source_contradiction', cluster_id, label, k, names, false from c join k using (cluster_id) where coherence > 0.8 and k > 3
union all select 'label_mismatch', cluster_id, label, null, label_warning, true from c where coalesce(label_warning, '') <> ''
union all select 'source_oversampling', cluster_id, label, top, s, top > 0.9 from c join k using (cluster_id) where k >= 2 and top > 0.7
union all select 'summary_template_artifact', cluster_id, label, null, topic, false from c where mode = 'meta_descriptive_summary' and topic not in ('', 'general') and contains(lower(label), split_part(topic, '_', 1))
union all select 'embedding_bias_suspected', cluster_id, label, density, s, false from c join k using (cluster_id) where density > {high} and k = 1)"""


_PLAIN = "select cluster_id, label, coherence, density, taxonomy.topic as topic, taxonomy.mode as mode, taxonomy.label_warning as label_warning from clusters where cluster_id is not null"
_WITH_ODD = f"""{_PLAIN} union all select * from (values (9001, 'Quantum notes', 0.9, 0.99, 'quantum_mechanics', 'meta_descriptive_summary', ''), (9002, 'Loose ends', 0.9, 0.99, 'quantum_mechanics', 'meta_descriptive_summary', ''), (9003, 'History of didactic work', 0.9, 0.99, 'history', 'meta_descriptive_summary', 'label says x, content is y'))"""
_SHOWN = "select type, cluster_id, label as subject, round(measure, 5) as measure, detail, review as requires_review from f"


def _classified(rows: str, key: str, text: str) -> str:
    """SQL of the classifier from its vocabulary: a row per key with topic, mode, posture, confidence."""
    parts, thresholds = [], taxonomy.THRESHOLDS
    for axis in ("topic", "mode", "posture"):
        score = [(c, " + ".join(f"case when contains(t, {_quoted(p)}) then {w} else 0 end" for p, w in s)) for c, s in DEFAULT[axis].items()]
        every = ", ".join(f"{{'s': {s}, 'c': {_quoted(c)}}}" for c, s in score)
        parts.append(f"{axis} as (select {key}, list(e order by e.s desc, e.c) as o from (select {key}, unnest([{every}]) as e from texts) group by {key})")
    pick = lambda a: f"case when {a}.o[1].s >= {thresholds[a][0]} then {a}.o[1].c else '{thresholds[a][1]}' end"
    sure = lambda a: f"case when {a}.o[1].s >= {thresholds[a][0]} then ({a}.o[1].s - {a}.o[2].s)::double / ({a}.o[1].s::double + 1e-9) else 0 end"
    return f"""
with texts as (select {key}, lower(coalesce({text}, '')) as t from ({rows})), {', '.join(parts)}
select topic.{key} as {key}, {pick('topic')} as topic, {pick('mode')} as mode, {pick('posture')} as posture, round(({sure('topic')} + {sure('mode')} + {sure('posture')}) / 3, 5) as confidence
from topic join mode using ({key}) join posture using ({key})"""


ORACLES = {
    "p4_found": """
with good as (select distinct run_id, attempt from excavation_runs where lower(trim(status)) = 'succeeded'),
done as (select id, max(seq) as seq from processed_points p where exists (select 1 from good g where g.run_id = p.run_id and g.attempt = p.attempt) group by id),
cur as (select * from (select *, row_number() over (partition by id order by seq desc) as r from points) where r = 1),
was as (select * from (select p.*, row_number() over (partition by p.id) as r from points p join done d on p.id = d.id and p.seq = d.seq) where r = 1)
select cur.id from cur left join was on cur.id = was.id
where was.id is null or cur.embedding is distinct from was.embedding or cur.fragment is distinct from was.fragment or cur.source is distinct from was.source or cur.layer is distinct from was.layer
""",
    "s_collection_size": f"select count(*) as points, sum(case when {_USABLE} then 1 else 0 end)::bigint as usable from ({_ROWS})",
    "s_extract": f"select id, source, layer, fragment from ({_ROWS}) order by id limit 500",
    "s_unprocessed": f"select id from ({_ROWS}) where id not in (select id from processed_points where id is not null)",
    "s_cut": f"select id, case when length(fragment) > 120 then substr(fragment, 1, 117) || '...' else fragment end as short from ({_ROWS})",
    "s_centroid_sources": "select source, pos, round(avg(x), 5) + 0.0 as value from (select source, unnest(centroid)::double as x, unnest(range(0, 96)) as pos from clusters where source is not null and cluster_id is not null) group by all",
    "s_payload": f"""
select id, {_CUT.format('f', 500)} as fragment, source, layer, run_id from (select id, coalesce(run_id, '') as run_id,
  case when id % 2 = 1 then source when id % 4 = 0 then source || '.txt' else 'unknown' end as source, case when id % 2 = 1 then layer else 'calm' end as layer,
  case when id % 2 = 1 then concat_ws(' | ', nullif(fragment, ''), layer || ' | ' || source, 'Concepts: ' || layer) when id % 4 = 0 then concat_ws(' | ', {_CUT.format("nullif(fragment, '')", 300)}, 'Verdict: kept')
  else coalesce({_CUT.format("nullif(fragment, '')", 500)}, 'N/A') end as f from ({_ROWS}) where len(embedding) = 96)
""",
    "s_mean_vector": f"select pos, round(avg(x), 4) as mean from (select unnest(range(0, 96)) as pos, unnest(list_transform(range(1, 97), lambda i: ((embedding[i]::double + embedding[97 - i]::double) / 2)::float::double)) as x from ({_ROWS}) where len(embedding) = 96) where x is not null group by pos",
    "s_named_vector": f"select id, round(embedding[96]::double, 4) as named, case when id % 2 = 1 then round(embedding[1]::double, 4) else 7.0 end as stored from ({_ROWS}) where len(embedding) = 96",
    "s_ids": f"select * from (values ('7', '7'), ('18446744073709551615', '18446744073709551615'), ('18446744073709551616', '{0x1844674407370955}'), ('0123456789abcdef-0000', '{0x0123456789ABCDEF}'), ('ffffffff-ffff-ffff-0000', '18446744073709551615'), ('x', '0'), ('', '0')) as t(id, number)",
    "s_hosts": "select * from (values ('http://a.b:6333/x', 'a.b'), ('a.b:6333', 'a.b'), ('https://c.d', 'c.d'), ('e', 'e')) as t(url, host)",
    "s_stamped": f"select id, 'r1' as run_id from ({_ROWS}) where id % 2 = 0 union all select id, 'r2' from ({_ROWS}) where id % 3 = 0",
    "s_batches": f"select id, (select count(*) from ({_ROWS}) where id % 2 = 0 or id % 4 = 1) as total from ({_ROWS}) where id % 2 = 0 or id % 4 = 1 order by {_order()} limit 300",
    "s_settings": "select * from (values ('90s', 90.0::double), ('5m', 300.0), ('1h30m', 5400.0), ('250ms', 0.25)) as t(text, seconds)",
    "sample_dispatch": f"""
with r as (select source, count(*) as n from ({_ROWS}) group by source), t as (select sum(n)::bigint as n, count(*) as k from r)
select 'random' as strategy, 400 as size, (select least(400, n)::bigint from t) as rows union all select 'stratified', 400, (select case when max(t.n) <= 400 then max(t.n) else sum(least(r.n, 400 // t.k)) end::bigint from r, t)
union all select 'proportional', 400, (select case when max(t.n) <= 400 then max(t.n) else sum(least(r.n, floor(r.n * 400 / t.n + 0.5))) end::bigint from r, t) union all select 'no such name', 7, 7 union all select 'random', 0, (select n from t)
""",
    "sample_capped": f"select id from ({_ROWS}) order by {_order()} limit 1000",
    "sample_diverse": f"""
with recursive p as (select id, embedding::double[] as e, row_number() over (order by {_order()}) as o from ({_ROWS}) where {_USABLE}),
step(n, id, o, near) as (select 1, p.id, p.o, case when p.o = 1 then -1 else list_distance(p.e, f.e) end from p, (select e from p where o = 1) f
union all select s.n + 1, s.id, s.o, case when s.near < 0 or s.id = c.id then -1 else least(s.near, list_distance(p.e, c.e)) end
from step s join p on p.id = s.id, (select t.id, q.e from step t join p q on q.id = t.id order by t.near desc, t.o limit 1) c where s.n < 100)
select id from step where n = 100 and near < 0
""",
    "sample_random": f"select id, source from ({_ROWS}) order by {_order()} limit 400",
    "sample_stratified": f"select id, source from (select id, source, row_number() over (partition by source order by {_order()}) as r from ({_ROWS})) where r <= 400 // (select count(distinct source) from ({_ROWS}))",
    "sample_proportional": f"select id, source from (select id, source, row_number() over (partition by source order by {_order()}) as r, count(*) over (partition by source) as n, count(*) over () as total from ({_ROWS})) where r <= floor(n * 400 / total + 0.5)",
    "sample_temporal": f"select id from (select id, row_number() over (partition by time_bucket(interval 1 day, arrived_at, timestamp '1970-01-01') order by {_order()}) as r from ({_ROWS}) where arrived_at is not null) where r <= 5",
    "v_pairs": f"select cluster_a, cluster_b, round(similarity, 5) as similarity, {_LINK.format('similarity')} as link_type from ({_PAIRS})",
    "v_distances": f"select a.cluster_id as cluster_a, b.cluster_id as cluster_b, round(greatest(0, least(2, 1 - {_COSINE.format('a.centroid', 'b.centroid')})), 5) as distance, 2.0::double as other_length from clusters a, clusters b where a.cluster_id < b.cluster_id and a.cluster_id % 3 = b.cluster_id % 3",
    "c_edges": f"with v as ({_UNIT}) select x as s, y as t, round(greatest(distance, 0), 5) + 0.0 as distance from ({_EDGES}) where x < y",
    "c_dbscan": f"{_DBSCAN} select id, cluster_id, is_core from labels",
    "c_described": f"""{_DBSCAN},
m as (select l.cluster_id, v.id, v.embedding, list_transform(v.e, lambda x: x / v.m) as u, v.source, v.layer from labels l join v using (id) where l.cluster_id > 0),
c as ({_CENTROIDS}), cu as (select cluster_id, list(value order by pos) as centre from (select cluster_id, pos, avg(x) as value from (select cluster_id, unnest(u) as x, unnest(range(0, 96)) as pos from m) group by all) group by cluster_id),
t as (select cluster_id, count(*)::int as size, avg({_COSINE.format('m.embedding', 'c.centroid')}) as coherence, 1 / (1 + avg(list_distance(m.u, cu.centre))) as density from m join c using (cluster_id) join cu using (cluster_id) group by cluster_id),
ly as (select *, row_number() over (partition by cluster_id order by n desc, layer) as r from (select cluster_id, layer, count(*) as n from m group by all)), sc as (select *, row_number() over (partition by cluster_id order by n desc, source) as r from (select cluster_id, source, count(*) as n from m group by all))
select cluster_id, layer || ' / ' || source as label, source, size, round(density, 4) as density, round(coherence, 4) as coherence from t join ly using (cluster_id) join sc using (cluster_id) where ly.r = 1 and sc.r = 1
""",
    "v_normalised": f"select pos, round(avg(x / m), 5) as mean from (select sqrt({_DOT.format('embedding', 'embedding')}) as m, unnest(embedding)::double as x, unnest(range(0, 96)) as pos from ({_ROWS}) where {_USABLE}) group by pos",
    "c_centroids": f"with m as ({_MEMBERS}) select cluster_id, pos, round(avg(x), 5) + 0.0 as value from ({_LONG}) group by all",
    "c_coherence": f"""
with m as ({_MEMBERS}), c as ({_CENTROIDS}), s as (select cluster_id, count(*) as size, avg({_COSINE.format('embedding', 'centroid')}) as coherence, 1 / (1 + avg(list_distance(embedding::double[], centroid))) as density from m join c using (cluster_id) group by cluster_id)
select cluster_id, size, round(coherence, 5) as coherence, round(density, 5) as density, case when coherence >= 0.7 then 'high' when coherence >= 0.4 then 'mid' else 'low' end as band from s
""",
    "c_labels": f"""
with m as ({_MEMBERS}), l as (select *, row_number() over (partition by cluster_id order by n desc, layer) as r from (select cluster_id, layer, count(*) as n from m group by all)), s as (select *, row_number() over (partition by cluster_id order by n desc, source) as r from (select cluster_id, source, count(*) as n from m group by all))
select cluster_id, layer || ' / ' || source as label, layer, source from l join s using (cluster_id) where l.r = 1 and s.r = 1
""",
    "b_bridges": f"select cluster_a, cluster_b, round(similarity, 5) as strength, {_LINK.format('similarity')} as link_type from ({_PAIRS}) where similarity > 0.3",
    "b_moats": f"select cluster_a, cluster_b, round(1 - similarity, 5) as distance from ({_PAIRS}) where similarity < 0.1",
    "b_links": f"""
with m as (select * from (select *, row_number() over (partition by cluster_id order by id) as r from ({_MEMBERS})) where r <= 50),
p as (select distinct least(cluster_a, cluster_b) as cluster_a, greatest(cluster_a, cluster_b) as cluster_b from bridges),
s as (select p.*, {_COSINE.format('a.embedding', 'b.embedding')} as similarity, a.id as x, b.id as y from p join m a on a.cluster_id = p.cluster_a join m b on b.cluster_id = p.cluster_b)
select cluster_a, cluster_b, r::int as rank, round(similarity, 5) as similarity from (select *, row_number() over (partition by cluster_a, cluster_b order by similarity desc, x, y) as r from s) where r <= 5
""",
    "b_support": f"select {_SUPPORT.format(_HITS)}, count(*) as bridges from bridges group by support",
    "b_support_classes": f"select {_SUPPORT.format(_SOME)}, count(*) as bridges from {_LINKED} group by support",
    "b_crosscheck": f"select {_CHECK.format(_HITS)}, coalesce(avg(case when {_HITS} > 0 then 1.0 else 0.0 end), 0)::double as ratio from bridges",
    "b_crosscheck_mixed": f"select {_CHECK.format(_SOME)}, round(coalesce(avg(case when {_SOME} > 0 then 1.0 else 0.0 end), 0)::double, 6) as ratio from {_LINKED}",
    "b_strongest": "select distinct cluster_a, cluster_b, strength from bridges order by strength desc, cluster_a, cluster_b limit 10",
    "b_widest": "select distinct cluster_a, cluster_b, distance from moats order by distance desc, cluster_a, cluster_b limit 5",
    "a_findings": f"{_anomalies(_PLAIN, 0.5, 0.3, 0.95)} {_SHOWN}",
    "a_branches": f"{_anomalies(_WITH_ODD, *ODD)} {_SHOWN}",
    "a_scores": f"""{_anomalies(_WITH_ODD, *ODD)}
select type, cluster_id, round(case type when 'coherence_anomaly' then 1 - coherence when 'density_anomaly' then abs(density - 0.7) when 'orphan_cluster' then 0.9 when 'source_contradiction' then 0.95 else 0.5 end, 5) as score from f join c using (cluster_id)""",
    "t_documents": _classified("select * from documents", "doc_id", "text"),
    "t_fragments": f"select topic, mode, posture, count(*) as points from ({_classified(_ROWS, 'id', 'fragment')}) group by all",
    "t_clusters": f"""
with q as (select cluster_id, string_agg(f, ' ' order by r) as t from (select cluster_id, substr(fragment, 1, 300) as f, row_number() over (partition by cluster_id order by seq, fragment) as r from (select cluster_id, fragment, min(seq) as seq from ({_TEXTS}) group by cluster_id, fragment)) where r <= 12 group by cluster_id),
k as ({_classified('select c.cluster_id, q.t from clusters c left join q using (cluster_id) where c.cluster_id is not null', 'cluster_id', 't').replace(', 5) as confidence', ', 5) as sure')})
select c.cluster_id, k.topic, k.mode, k.posture as epistemic_posture, case when contains(label, ' / ') then trim(substr(label, instr(label, ' / ') + 3)) else label end as source_family, {_warning('label', 'k.topic', 'k.mode')} as label_warning from clusters c join k using (cluster_id)
""",
    "t_warnings": f"""
with r as (select * from (values ('deep / quantum notes', 'quantum_mechanics', 'scholarly_annotation'), ('Didactic notes', 'history', 'scholarly_annotation'), ('didactic notes', 'history', 'didactic_teaching'), ('ancient empire', 'biology', 'unknown'), ('ancient cell', 'biology', 'unknown'), ('theorem', '', 'unknown'), ('theorem', 'general', 'unknown'), (null, 'biology', 'unknown'), ('plain', 'biology', 'unknown')) as t(label, topic, mode))
select label, topic, mode, {_warning('label', 'topic', 'mode')} as warning, contains(lower(label), split_part(topic, '_', 1)) or {' or '.join(f"(topic = '{t}' and ({' or '.join(f'contains(lower(label), {_quoted(w)})' for w in ws)}))" for t, ws in LABEL_KEYWORDS.items())} as names_topic from r
""",
    "t_vocabularies": f"select * from (values {', '.join(f'({_quoted(k)}, {_quoted(n)})' for k, names in (('mode', taxonomy.MODES), ('posture', taxonomy.POSTURES), ('anomaly', taxonomy.ANOMALIES)) for n in names)}) as t(kind, name)",
    "t_query": "select cluster_id from clusters where cluster_id is not null and (lower(taxonomy.mode) = 'scholarly_annotation' or coalesce(taxonomy.label_warning, '') <> '')",
    "t_families": "select cluster_id, case when contains(label, ' / ') then trim(substr(label, instr(label, ' / ') + 3)) else label end as family from clusters where cluster_id is not null",
    "q_search": """
with o as (select label from clusters where cluster_id is not null and cluster_id not in (select cluster_a from bridges where cluster_a is not null union select cluster_b from bridges where cluster_b is not null))
select 'cluster' as kind, label as title from clusters where cluster_id is not null and contains(lower(label), 'surface')
union all select 'bridge', t from (select 'Cluster ' || cluster_a || ' ↔ ' || cluster_b || ' (' || link_type || ')' as t from bridges) where contains(lower(t), 'surface')
union all select 'anomaly', label from o where contains(lower(label), 'surface')
""",
    "q_listed": f"select row_number() over (order by density, cluster_id)::int as place, cluster_id, density from clusters where density < {ODD[1]} or density > {ODD[2]}",
    "q_titles": "select m.cluster_a, m.distance, coalesce(c.label, '#' || m.cluster_a) as title from moats m left join clusters c on m.cluster_a = c.cluster_id",
    "q_summary": "select (select count(*) from clusters where cluster_id is not null) as clusters, (select count(*) from bridges) as bridges, (select count(*) from moats) as moats, (select count(*) from clusters where coherence < 0.5) as anomalies",
    "q_finding_members": f"select 'coherence_anomaly-' || m.cluster_id as finding_id, m.id as member_id from ({_MEMBERS}) m join clusters c using (cluster_id) where c.coherence < {ODD[0]}",
    "r_prompts": "select cluster_a, cluster_b, printf('Bridge: %d ↔ %d, strength %.2f (%s)', cluster_a, cluster_b, strength, link_type) as prompt from bridges",
    "q_subjects": "select * from (values ('Cluster 4: x', '4', 4), ('Bridge: 2 ↔ 3', '2,3', 2), ('Moat: 5 ⊥ 6', '5,6', 0), ('Moat: 5 ↔ 6', '5,6', 5), ('Cluster x: 4', '', 8), ('', '', 0)) as t(subject, named, about)",
    "q_read_back": "select (select count(*) from clusters where cluster_id is not null) as clusters, (select count(*) from bridges) as bridges, (select count(*) from moats) as moats, (select count(*) from clusters where cluster_id is not null and cluster_id not in (select cluster_a from bridges where cluster_a is not null union select cluster_b from bridges where cluster_b is not null)) as anomalies",
    "q_export": "select 'moats' as kind, (select count(*) from moats) as count, cluster_a, cluster_b from moats",
    "r_snippets": f"""
with p as (select *, row_number() over (partition by cluster_id order by seq) - 1 as pos, greatest(1, count(*) over (partition by cluster_id) // 24) as step from ({_TEXTS})),
t as (select cluster_id, t, min((later, pos)) as o from (select cluster_id, case when length(fragment) > 200 then substr(fragment, 1, 200) || '...' else fragment end as t, pos % step <> 0 as later, pos from p) group by cluster_id, t)
select cluster_id, (r - 1)::int as pos, t as snippet from (select *, row_number() over (partition by cluster_id order by o) as r from t) where r <= 8
""",
    "r_conclusions": "select cluster_a, cluster_b, 'Bridge: ' || cluster_a || ' ↔ ' || cluster_b || ', strength ' || split_part(printf('%.2f', strength), '.', 1) || '.' as conclusion from bridges order by strength desc, cluster_a, cluster_b limit 10",
}
_LABEL_PROMPTS = f"""select c.cluster_id, 'Name what these texts of ' || coalesce(size::varchar, 'unknown') || ' points share (coherence ' || coalesce(printf('%.2f', coherence), 'unknown') || '), in three to six words and nothing else.' || chr(10) || '---' || chr(10) || t.t as prompt
from clusters c join (select cluster_id, string_agg(fragment, chr(10) || '---' || chr(10) order by r) as t from (select *, row_number() over (partition by cluster_id order by seq, id) as r from ({_TEXTS})) where r <= 8 group by cluster_id) t using (cluster_id)"""
_TOLD = f"""
with c as (select cluster_id, label, source, coherence from clusters where cluster_id is not null), b as (select distinct on (cluster_a, cluster_b) * from bridges), m as (select distinct on (cluster_a, cluster_b) * from moats),
tb as (select * from b order by strength desc, cluster_a, cluster_b limit 10), tm as (select * from m order by distance desc, cluster_a, cluster_b limit 5),
f as (select 'cluster_analysis' as type, 'Cluster ' || cluster_id || ': ' || coalesce(label, 'null') as subject, 0.75::double as confidence, coalesce(coherence < {ODD[0]}, false) as is_anomaly, cluster_id::varchar as clusters, cluster_id, [cluster_id] as ends from c
union all select 'bridge_analysis', 'Bridge: ' || cluster_a || ' ↔ ' || cluster_b, 0.75, false, cluster_a || ',' || cluster_b, cluster_a, [cluster_a, cluster_b] from tb
union all select 'moat_analysis', 'Moat: ' || cluster_a || ' ⊥ ' || cluster_b, 0.75, true, '', 0, [] from tm
union all select 'orphan_cluster', label, null, true, cluster_id::varchar, cluster_id, [] from c where cluster_id not in (select cluster_a from bridges where cluster_a is not null union select cluster_b from bridges where cluster_b is not null))"""
_ODD_ONES = "(select count(*) from f where is_anomaly)"
ORACLES |= {
    "r_label_prompts": _LABEL_PROMPTS,
    "r_named": f"select c.cluster_id, case when len(string_split(p.prompt, ' ')) % 2 = 0 then len(string_split(p.prompt, ' ')) || ' words' || chr(34) else c.label end as label from clusters c left join ({_LABEL_PROMPTS}) p using (cluster_id) where c.cluster_id is not null",
    "r_findings": f"{_TOLD} select type, subject, confidence, is_anomaly, clusters, true as told from f",
    "q_reasoned": f"{_TOLD} select cluster_id, true as reasoned, coalesce(coherence < {ODD[0]}, false) as is_anomaly, cluster_id in (select cluster_id from f where is_anomaly) as has_anomaly from c",
    "q_pairs_reasoned": f"{_TOLD}, both_ as (select 'bridge' as kind, cluster_a as x, cluster_b as y from tb union all select 'bridge', cluster_b, cluster_a from tb union all select 'moat', cluster_a, cluster_b from tm union all select 'moat', cluster_b, cluster_a from tm) select kind, cluster_a, cluster_b, (kind, cluster_a, cluster_b) in (select (kind, x, y) from both_) as reasoned from (select 'bridge' as kind, cluster_a, cluster_b from b union all select 'moat', cluster_a, cluster_b from m)",
    "q_anomalies": f"{_TOLD} select type, subject, cluster_id from f where is_anomaly",
    "q_document": f"{_TOLD} select name, n as total, n as entries from (select 'clusters' as name, count(*) as n from c union all select 'bridges', count(*) from b union all select 'moats', count(*) from m union all select 'anomalies', {_ODD_ONES})",
    "q_markdown": f"{_TOLD} select kind, n as lines from (select 'cluster' as kind, count(*) as n from c union all select 'bridge', count(*) from b union all select 'moat', count(*) from m union all select 'anomaly', {_ODD_ONES}) where n > 0",
    "q_stored": f"{_TOLD}, p as (select cluster_id, id from ({_MEMBERS})) select type, subject, clusters as clusters_text, (select count(distinct p.id) from p where list_contains(ends, p.cluster_id)) as members from f",
    "r_promoted": f"{_TOLD}, said as (select least(cluster_a, cluster_b) as lo, greatest(cluster_a, cluster_b) as hi, min('Bridge: ' || cluster_a || ' ↔ ' || cluster_b) as t from tb group by lo, hi) select 'cluster' as kind, cluster_id, case when cluster_id % 2 = 0 then label else source end as source, substr(case when cluster_id % 2 = 0 then 'Cluster ' || cluster_id || ':' else label end, 1, 10) as label from c where cluster_id <= 10 union all select 'bridge', cluster_a, cluster_b::varchar, substr(coalesce(t, label), 1, 10) from b left join said on lo = least(cluster_a, cluster_b) and hi = greatest(cluster_a, cluster_b)",
    "w_deliveries": "select distinct id, seq from points where arrived_at is not null",
    "w_incremental": f"select id, 1 as run from ({_ROWS}) where id % 7 <> 0 union all select id, 2 from ({_ROWS}) where id % 7 = 0 or (id % 11 = 0 and fragment is not null)",
}
