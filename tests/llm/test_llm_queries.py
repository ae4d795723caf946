"""Each query against SQL, on the smallest tables, on empty ones, and on tables full of odd rows."""

import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orebody.llm import grouping, leakage, mixing, neardup, neighbours, proportions, queries, repetition, variety, vectors
from orebody.operators import components

SMALL = "/root/testdata/sf0.001"
TABLES = ("points", "documents", "eval_items", "sample_targets", "mix_targets")
LONG = " ".join(f"w{i % 997}" for i in range(2_000))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_as_sql_says(name, same):
    same(queries.QUERIES[name], queries.ORACLES[name])


def _folder(tmp, rows):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create table {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    rows(con)
    for t in TABLES:
        con.execute(f"copy {t} to '{tmp}/{t}.parquet' (format parquet)")
    return con


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    tmp = tmp_path_factory.mktemp("empty")
    _folder(tmp, lambda con: [con.execute(f"delete from {t}") for t in TABLES])
    return str(tmp)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_give_nothing(name, empty, spark):
    assert queries.QUERIES[name](spark, empty).count() == 0


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Nulls in all columns, empty and very long texts, repeated rows, and columns named like inner ones."""

    def add(con):
        con.execute("insert into points select null, 1, [1.0], 'x', 'a', 'b', 'r', null, null")
        con.execute("insert into points select 900001, 9000001, null, null, null, null, null, null, null")
        con.execute("insert into points select 900002, 9000002, list_transform(range(96), lambda x: 0)::float[], '', '', ' ', '', null, null")
        for i in range(12):  # copies: equal vectors and fragments under other ids, some delivered twice
            con.execute(f"insert into points select {900010 + i}, {9000010 + i}, embedding, fragment, source, layer, run_id, updated_at, arrived_at from points where id = (select min(id) from points where len(embedding) = 96 and len(fragment) > 200)")
        con.execute("insert into points select * from points where id > 900015")
        con.execute("insert into documents (doc_id, text) values (900001, null), (900002, ''), (900003, ' \t\n'), (900004, repeat('same five words again here ', 20))")
        con.execute("insert into documents (doc_id, text) values (900005, ?)", [LONG])
        con.execute("insert into documents (doc_id, text) select 900006, text || ' tail' from eval_items where len(text) > 80 limit 1")
        con.execute("insert into eval_items values (900001, null, null), (900002, 'b', ''), (900003, 'b', 'w1 w2 w3 w4')")
        con.execute("insert into eval_items select 900004, 'c', text from eval_items where len(text) > 80 limit 1")
        for t, columns in (("points", ("n", "rep", "code", "part", "__rank")), ("documents", ("n", "tokens", "lengths"))):
            for c in columns:
                con.execute(f'alter table {t} add column "{c}" varchar')

    tmp = tmp_path_factory.mktemp("odd")
    return str(tmp), _folder(tmp, add)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_odd_rows(name, odd, spark):
    folder, con = odd
    df = queries.QUERIES[name](spark, folder)
    found = con.execute(queries.ORACLES[name])
    at = [c[0] for c in found.description]
    want = sorted(tuple(r[at.index(n)] for n in df.columns) for r in found.fetchall())
    assert sorted(tuple(r) for r in df.collect()) == want and want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_odd_rows_without_sql(name, odd, spark):
    assert queries.QUERIES[name](spark, odd[0]).count() > 0


def test_short_sources_by_count(spark):
    """Tokens by the same public tokenizer, summed in plain Python."""
    from orebody.functions.columns import source_category

    read = lambda t: spark.read.parquet(f"{SMALL}/{t}.parquet")
    encode = mixing._encoding(open(mixing.TOKENIZER, "rb").read()).encode_ordinary
    size = {}
    for r in read("documents").select(source_category().alias("s"), "text").collect():
        size[r.s] = size.get(r.s, 0) + len(encode(r.text or ""))
    total = sum(size.values())
    want = {r.s for r in read("mix_targets").select(source_category().alias("s"), "target_share", "max_repeats").collect() if r.max_repeats * size.get(r.s, 0) < r.target_share * 0.4 * total}
    assert {r.source.strip().lower() for r in queries.p8_found(spark, SMALL).collect()} == want


def test_recall_of_links(spark):
    """Links of the asked points against brute force."""
    d = "/root/testdata/sf0.01"
    found = {(r.id, r.linked_id) for r in queries.p6_links(spark, d).collect()}
    rows = sorted({r.id: (r.seq, r.embedding) for r in spark.read.parquet(f"{d}/points.parquet").where("id is not null").orderBy("seq").collect()}.items())
    rows = [(i, v) for i, (_, v) in rows if v is not None and len(v) == 96 and None not in v and any(v)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -2
        want |= {(int(ids[q]), int(ids[j])) for j in np.argsort(-s, kind="stable")[:5]}
    assert len(found & want) / len(want) >= 0.9


def test_raking_meets_both_margins():
    counts = np.array([100.0, 50, 30, 20])
    w = proportions.rake(counts, [(np.array([0, 0, 1, 1]), np.array([0.3, 0.7])), (np.array([0, 1, 0, 1]), np.array([0.6, 0.4]))])
    assert np.allclose([w[0] + w[1], w[0] + w[2], w.sum()], [0.3, 0.6, 1])
    assert proportions.rake(np.zeros(2), [(np.array([0, 1]), np.array([0.5, 0.5]))]).sum() == 0


def test_farthest_first_prefers_what_is_different():
    x = np.eye(6, dtype=np.float32)[[0, 0, 0, 0, 1, 2, 3]]
    assert set(variety.farthest_first(x, np.array([0]), 4)) == {0, 4, 5, 6}


def test_places_go_where_it_is_far_over_many_regions(spark, monkeypatch):
    """A large group of similar points gets no places that far points need, however many parts send it."""
    monkeypatch.setattr(variety, "PART_ROWS", 64)
    rng = np.random.default_rng(3)
    x = np.concatenate([np.eye(96)[0] * 20 + rng.normal(size=(2_000, 96)), np.repeat(np.eye(96)[1:61], 3, axis=0) * 20 + rng.normal(size=(180, 96)) * 0.1])
    df = spark.createDataFrame([(i, i, v.tolist(), "s", "l") for i, v in enumerate(x.astype(np.float32))], "id long, seq long, embedding array<float>, source string, layer string")
    chosen = [r.id for r in variety.varied_subset(df, 0.1).collect()]
    assert len(chosen) == len(set(chosen)) == 218
    assert {(i - 2_000) // 3 for i in chosen if i >= 2_000} == set(range(60))


def test_tiles_lose_no_pair():
    rng = np.random.default_rng(7)
    base = [set(rng.integers(0, 2**63, 40)) for _ in range(30)]
    sets = base + [set(list(s)[: 40 - k]) for k, s in enumerate(base) if k < 15]
    flat = np.concatenate([np.array(sorted(s), np.uint64) for s in sets])
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    n, zero = np.array([len(s) for s in sets]), np.zeros(len(sets), np.int64)
    a, b = neardup.compare_tiles(zero, zero, zero, zero, np.arange(len(sets)), n, neardup._sketch(flat, row, len(sets)), 0.8)
    want = {(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    assert want <= {(max(p), min(p)) for p in zip(a.tolist(), b.tolist())} and want


def test_only_copies_of_the_same_words_are_starred(spark):
    """Texts that go round a circle of words have equal sets of runs, whatever their length."""
    circle = lambda n: " ".join(f"w{i % 20}" for i in range(n))
    texts = [(i, circle(22 + i)) for i in range(6)] + [(10 + i, circle(60)) for i in range(5)] + [(20, circle(22) + " x y z")]
    found = neardup.NearDuplicates(spark.createDataFrame(texts, "id long, text string"), shingle=3, similarity=0.5, min_words=15)
    every = [0, 1, 2, 3, 4, 5, 10, 11, 12, 13, 20]  # ids 11 to 14 are copies of 10, of which four have all pairs
    want = {(a, b) for a in every for b in every if a < b} | {(10, 14)}
    pairs = [(r.id_a, r.id_b) for r in found.text_pairs(copies=4).collect()]
    assert set(pairs) == want and len(pairs) == len(want)
    assert {(r.id_a, r.id_b) for r in found.text_pairs().collect()} == {(a, b) for a, _ in texts for b, _ in texts if a < b}


def test_index_of_equal_vectors(spark):
    v = [1.0] + [0.0] * 95
    df = spark.createDataFrame([(i, i, v) for i in range(8)] + [(9, 9, [0.0] * 96), (10, 10, [None] * 96), (11, 11, []), (12, 12, None)], "id long, seq long, embedding array<float>")
    found = {(r.chunk_a_id, r.chunk_b_id) for r in neighbours.similar_pairs(df).collect()}
    assert found == {(min(i, j), max(i, j)) for i in range(8) for j in [k for k in range(8) if k != i][:5]}


def _dense(spark, rows=380):
    """A group of near-equal vectors, by ids; as a table and in double."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=96) * 14 + rng.normal(size=(rows, 96))
    x = x.astype(np.float32)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    best = np.argsort(-s, axis=1, kind="stable")[:, :5]
    return spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(x)], "id long, seq long, embedding array<float>"), best


def test_dense_group_keeps_its_nearest(spark):
    df, best = _dense(spark)
    found = {(r.chunk_a_id, r.chunk_b_id) for r in neighbours.similar_pairs(df).collect()}
    assert found == {(min(i, int(j)), max(i, int(j))) for i in range(len(best)) for j in best[i]}


def test_dense_group_keeps_its_nearest_without_floor(spark):
    df, best = _dense(spark)
    found = {(r.id, r.rank): r.neighbour for r in neighbours.VectorIndex(df).neighbours(5, df.where("id % 20 = 0")).collect()}
    assert found == {(i, r + 1): int(best[i, r]) for i in range(0, len(best), 20) for r in range(5)}


def test_possible_keeps_what_the_error_allows():
    s, error = np.array([[0.99, 0.98, 0.97, 0.5]]), np.full((1, 4), 0.006)
    assert neighbours.possible(s, error, 1, 0.95).tolist() == [[True, True, False, False]]
    assert neighbours.possible(s, error, 5, 0.955).tolist() == [[True, True, True, False]]


def test_passages(spark):
    docs = spark.createDataFrame([(1, "zero " + " ".join(f"a{i}" for i in range(12)) + " end"), (2, " ".join(f"a{i}" for i in range(11))), (3, "b c"), (4, None), (5, "b, C!")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "x " + " ".join(f"A{i}" for i in range(12))), (2, "b c"), (3, ""), (4, "b c")], "item_id long, text string")
    assert sorted(map(tuple, leakage.leaks(docs, items).collect())) == [(1, 1), (3, 2), (3, 4), (5, 2), (5, 4)]


def test_repetition_threshold(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " " + text), (3, "a b c d e " * 5), (4, "a b c d e " * 6), (5, None)], "doc_id long, text string")
    for c in ("lang", "source", "kind"):
        docs = docs.selectExpr("*", f"cast(null as string) as {c}")
    assert sorted(r.doc_id for r in repetition.repetitive(docs).collect()) == [2, 4]


def test_pairs_of_a_large_class_have_one_form(spark):
    """1,500 copies of a text, another text of the same runs, and a similar one: no link between different texts is lost."""
    text = " ".join(f"w{i % 20}" for i in range(40))
    texts = [(i, text) for i in range(1_500)] + [(5_000, text + " w0"), (6_000, text + " x y z")]
    found = neardup.NearDuplicates(spark.createDataFrame(texts, "id long, text string"), shingle=3, similarity=0.5, min_words=15)
    k = neardup.COPIES
    want = {(i, j) for j in range(k) for i in range(j)} | {(0, j) for j in range(k, 1_500)} | {(i, j) for i in range(k) for j in (5_000, 6_000)} | {(5_000, 6_000)}
    pairs = [(r.id_a, r.id_b) for r in found.text_pairs().collect()]
    assert set(pairs) == want and len(pairs) == len(want)
    groups = found.groups().collect()
    assert len(groups) == 1_502 and {r.group_id for r in groups} == {0} and {r.class_id for r in groups} == {0, 6_000}


def _usable(spark, d):
    """Ids and unit vectors in double of the current usable points."""
    rows = sorted({r.id: (r.seq, r.embedding) for r in spark.read.parquet(f"{d}/points.parquet").where("id is not null").orderBy("seq").collect()}.items())
    rows = [(i, v) for i, (_, v) in rows if v is not None and len(v) == 96 and None not in v and any(v)]
    x = np.array([v for _, v in rows], dtype=np.float64)
    return np.array([i for i, _ in rows]), x / np.linalg.norm(x, axis=1, keepdims=True)


def test_exact_neighbours_are_brute_force(spark):
    """With one list opened nothing would be exact; with ``exact`` it is, with and without a floor."""
    points = spark.read.parquet(f"{SMALL}/points.parquet")
    ids, x = _usable(spark, SMALL)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    best = {int(ids[q]): [int(ids[j]) for j in np.lexsort((ids, -np.round(s[q], 12)))[:5]] for q in range(len(ids))}
    index = neighbours.VectorIndex(points, list_rows=16)
    assert index.lists > 10
    found: dict = {}
    for r in index.neighbours(5, exact=True).orderBy("id", "rank").collect():
        found.setdefault(r.id, []).append(r.neighbour)
    assert found == best
    near = {(r.id, r.neighbour) for r in index.neighbours(5, min_similarity=0.95, exact=True).collect()}
    of = {int(i): k for k, i in enumerate(ids)}
    assert near == {(q, n) for q, row in best.items() for n in row if s[of[q], of[n]] >= 0.95} and near


def test_exact_groups_are_those_of_sql(spark, sql):
    """A mixture of few components, one a row, misses links; ``exact`` closes them."""
    want = sorted(sql.execute(queries.ORACLES["p3_found"]).fetchall())
    found = grouping.Clusters(spark.read.parquet(f"{SMALL}/points.parquet"), components=1, exact=True).members()
    assert sorted((r.group_id, r.id) for r in found.collect()) == want and want


def _block(x, roots=None):
    """All rows of ``x`` as one block in which each asks and is a member."""
    n = len(x)
    root = np.full(n, grouping.NONE, "<i8") if roots is None else np.asarray(roots, "<i8")
    code = vectors.binary(np.concatenate([vectors.encode(x / np.linalg.norm(x, axis=1, keepdims=True)), root.view(np.uint8).reshape(n, 8)], axis=1))
    return pa.table({"asks": np.ones(n, bool), "member": np.ones(n, bool), "id": np.arange(n) + 10, "code": code}).to_batches()


def _joined_rows(rows, n):
    a, b = (np.concatenate([r.column(i).to_numpy() for r in rows]) - 10 for i in (0, 1))
    return components.forest(n, a, b)


@pytest.mark.parametrize("noise", (0.03, 0.051))
def test_a_dense_block_takes_little_memory(noise):
    """Nearly all of 8.4 million pairs are similar, or too close to call."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=96)
    x = centre / np.linalg.norm(centre) + noise * rng.normal(size=(4_096, 96))
    block = _block(x)
    tracemalloc.start()
    try:
        found = list(grouping._comparison(0.8)(iter(block)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 200e6 and not _joined_rows(found, len(x)).any()


def test_blocks_in_parts_lose_no_pair():
    """With a few pairs held at once: surely similar rows are joined, and of the other pairs none that is similar is left out."""
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(30, 96)), 20, axis=0) + 0.5 * rng.normal(size=(600, 96))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argwhere(x @ x.T >= 0.8)
    for held in (50, 5_000, grouping.HELD):
        found = list(grouping._comparison(0.8, held)(iter(_block(x))))
        sure = [r.filter(r.column(2)) for r in found]
        a, b = (np.concatenate([r.column(i).to_numpy() for r in sure]) - 10 for i in (0, 1))
        label = components.forest(len(x), a, b)
        want = components.forest(len(x), *near.T)
        assert (want[label] == want).all()
        maybe = {(int(u) - 10, int(v) - 10) for r in found for u, v, s in zip(*(c.to_pylist() for c in r.columns)) if not s}
        assert all(label[i] == label[j] or (i, j) in maybe for i, j in near.tolist() if i < j) and maybe
    roots = np.arange(600) // 20 * 20 + 10
    assert (_joined_rows([r.filter(r.column(2)) for r in grouping._comparison(0.8)(iter(_block(x, roots)))], len(x)) == np.arange(len(x))).all()


def test_many_components_are_looked_at_in_part():
    """Of 4,096 components a row looks at a third at most, and its best is among them; few components are all looked at."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(64, 32)).repeat(64, axis=0) + 0.3 * rng.normal(size=(4_096, 32))
    f = (centre[:, None] + 0.1 * rng.normal(size=(4_096, 4, 32))).reshape(-1, 32).astype(np.float32)
    base = (np.zeros(32, np.float32), np.eye(32, dtype=np.float32))
    powers = grouping._powers(f[::16])
    g = grouping.Mixture(*base, np.full(4_096, 1 / 4_096), centre, np.full(centre.shape, 0.02))
    whole, part = grouping.Nearby(g, flat=4_096), grouping.Nearby(g)
    looked = [sum(len(r) * len(m) for r, m, _ in n.blocks(powers)) / len(powers) for n in (whole, part)]
    assert looked[0] == 4_096 and looked[1] < 1_400
    (a, x), (b, y) = whole.best(powers, 4), part.best(powers, 4)
    assert np.mean(np.take_along_axis(a, x.argmax(axis=1)[:, None], 1) == np.take_along_axis(b, y.argmax(axis=1)[:, None], 1)) > 0.99
    (s, p), (t, q) = whole.expected(powers), part.expected(powers)
    assert abs(p - q) < 1e-3 * abs(p) and abs(s - t).sum() < 1e-2 * abs(s).sum()
    few = grouping.Mixture(*base, np.full(3, 1 / 3), centre[:3], np.full((3, 32), 0.02))
    assert np.allclose(grouping.Nearby(few).expected(powers)[0][:, -1].sum(), len(powers), rtol=1e-5)


def test_groups_of_components_give_the_groups_of_sql(spark, sql, monkeypatch):
    """A mixture of which each row looks at a part only: hardly a row of the SQL is lost."""
    monkeypatch.setattr(grouping.Nearby.__init__, "__defaults__", (4, 2))
    want = set(sql.execute(queries.ORACLES["p3_found"]).fetchall())
    made = grouping.Clusters(spark.read.parquet(f"{SMALL}/points.parquet"))
    found = {(r.group_id, r.id) for r in made.members().collect()}
    assert len(made.mixture.weight) > 8 and len(found & want) >= 0.98 * len(want) and len(found - want) <= 0.02 * len(want)


def test_blocks_of_a_split_component_meet_once(spark, sql, monkeypatch):
    """Blocks of 64 rows, so that components are split: fewer products than of all asking rows and members, and the rows of the SQL."""
    made, in_blocks = [], grouping.in_blocks

    def kept(sides, *rest):
        made.append(sides.groupBy("list", "block", "q_block").agg(F.sum(F.col("asks").cast("long")).alias("a"), F.sum(F.col("member").cast("long")).alias("m")).agg(F.sum(F.col("a") * F.col("m"))).first()[0])
        each = sides.select("list", "id", "asks").groupBy("list", "id").agg(F.max("asks").alias("asks")).groupBy("list")
        made.append(each.agg(F.count("*").alias("m"), F.sum(F.col("asks").cast("long")).alias("a")).agg(F.sum(F.col("a") * F.col("m"))).first()[0])
        return in_blocks(sides, *rest)

    monkeypatch.setattr(grouping, "CELL_ROWS", 64)
    monkeypatch.setattr(grouping, "in_blocks", kept)
    found = {(r.group_id, r.id) for r in grouping.Clusters(spark.read.parquet(f"{SMALL}/points.parquet")).members().collect()}
    assert found == set(sql.execute(queries.ORACLES["p3_found"]).fetchall()) and made[0] < 0.75 * made[1]


def test_centroids_of_two_levels_and_their_graph():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(40, 96)), 30, axis=0) + 0.2 * rng.normal(size=(1_200, 96))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    c = neighbours.balanced_centroids(x, 100, flat=25)
    size = np.bincount(neighbours._nearest(x, c), minlength=len(c))
    assert 80 <= len(c) <= 120 and size.max() <= 60
    graph = neighbours.CentroidGraph(c, flat=25)
    found, _ = graph.search(x, 1)
    assert (found[:, 0] == (x @ c.T).argmax(axis=1)).mean() > 0.95


def test_mixture_fits_and_chooses(spark):
    """Likelihood grows with each update, and density is that of the formula."""
    rng = np.random.default_rng(4)
    f = np.concatenate([rng.normal(size=(300, 4)) * 0.2 + m for m in (np.zeros(4), np.full(4, 3.0), np.full(4, -3.0))]).astype(np.float32)
    base = (np.zeros(4, np.float32), np.eye(4, dtype=np.float32))
    likelihood = {}
    for k in (1, 3, 30):
        g, last = grouping._start(base, f, k), -np.inf
        for _ in range(6):
            p = g.log_parts(f).astype(np.float64)
            most = p.max(axis=1, keepdims=True)
            likelihood[k] = float((np.log(np.exp(p - most).sum(axis=1, keepdims=True)) + most).sum())
            assert likelihood[k] > last - 1e-3 * abs(last if last > -np.inf else 1)
            last = likelihood[k]
            w = np.exp(p - most) / np.exp(p - most).sum(axis=1, keepdims=True)
            g = g.update(w.sum(axis=0), w.T @ f, w.T @ (f.astype(np.float64) ** 2))
    bic = {k: -2 * v + (k * 9 - 1) * np.log(len(f)) for k, v in likelihood.items()}
    assert min(bic, key=bic.get) == 3
    one = grouping.Mixture(*base, np.array([1.0]), np.array([[1.0, 0, 0, 0]]), np.full((1, 4), 2.0))
    at = one.log_parts(np.array([[2.0, 1, 0, 0]], np.float32))[0, 0]
    assert np.isclose(at, -0.5 * (4 * np.log(2 * np.pi * 2.0) + (1 + 1) / 2.0), atol=1e-5)


def test_typical_members_are_the_densest(spark):
    made = grouping.Clusters(spark.read.parquet(f"{SMALL}/points.parquet"))
    group = {r.id: r.group_id for r in made.members().collect()}
    dense = {r.id: r.log_density for r in made.densities().collect()}
    found: dict = {}
    for r in made.typical(3).orderBy("group_id", "rank").collect():
        found.setdefault(r.group_id, []).append(r.id)
    for g, rows in found.items():
        assert rows == sorted((i for i in group if group[i] == g), key=lambda i: (-dense[i], i))[:3]
    parts = made.components().collect()
    assert sum(r.size for r in parts) == len(dense) and all(len(r.typical_ids) == min(5, r.size) for r in parts)


def test_regions_cover_as_the_whole_pool_does(spark, monkeypatch):
    """The least similarity of a point to its nearest chosen one, over many regions against farthest-first over all points."""
    points = spark.read.parquet("/root/testdata/sf0.01/points.parquet")
    ids, x = _usable(spark, "/root/testdata/sf0.01")

    def radius(chosen):
        return (x @ x[np.isin(ids, chosen)].T).max(axis=1).min()

    whole = radius(ids[variety.farthest_first(x.astype(np.float32), np.array([0]), 148)])
    monkeypatch.setattr(variety, "PART_ROWS", 64)
    chosen = [r.id for r in variety.varied_subset(points, 0.05).collect()]
    assert len(set(chosen)) == len(chosen) == -(-len(ids) // 20)
    assert radius(chosen) > whole - 0.06


def test_sample_meets_its_targets(spark):
    """What is drawn has the plan's size and what the report says; categories have their minimum and whole share, or all there is to spare."""
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    made = proportions.ProportionalSample(read("points"), read("sample_targets"))
    rows = made.sample().collect()
    again = proportions.ProportionalSample(read("points"), read("sample_targets")).sample().collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    report = made.report().collect()
    for plan in made.plans:
        own = [r for r in rows if r.plan_name == plan.name]
        assert len(own) == len({r.id for r in own}) == plan.size
        for t in (t for t in report if t.plan_name == plan.name):
            drawn = sum((t.source is None or r.source == t.source) and (t.layer is None or r.layer == t.layer) for r in own)
            assert drawn == t.drawn and abs(t.actual_share - drawn / plan.size) < 1e-9
            want = min(t.available, max(next(x["min_rows"] for x in plan.targets if x["target_id"] == t.target_id), int(t.target_share * plan.size)))
            assert drawn >= want
            assert t.met == (t.available >= t.needed) == (t.unmet == 0)


def test_repair_moves_rows_within_the_size():
    cells = [{"source": s, "layer": m, "n": n} for s, m, n in (("a", "x", 50), ("a", "y", 50), ("b", "x", 4), ("b", "y", 3))]
    target = lambda i, s, m, share, least: {"target_id": i, "plan_name": "p", "source": s, "layer": m, "target_share": share, "min_rows": least, "sample_share": 20 / 107}
    plan = proportions.Plan([target(1, "a", None, 0.9, 0), target(2, "b", None, 0.1, 6), target(3, None, "x", 0.5, 0), target(4, None, "y", 0.5, 0)], cells, 107)
    drawn = plan.repaired(np.array([15, 5, 0, 0]))
    assert drawn.sum() == 20 and drawn[2] + drawn[3] == 6 and drawn[0] + drawn[2] >= 10 and drawn[1] + drawn[3] >= 10 and (drawn <= plan.counts).all()
    assert (plan.repaired(np.array([10, 4, 3, 3])) == [10, 4, 3, 3]).sum() >= 2


def test_draw_follows_the_weights(spark):
    """Rows of weight three are drawn about three times as often where few are drawn."""
    df = spark.range(30_000).selectExpr("id", "id as seq", "case when id % 2 = 0 then 'a' else 'b' end as source", "'x' as layer")
    targets = spark.createDataFrame([(1, "p", "a", None, 0.75, 0, 0.02), (2, "p", "b", None, 0.25, 0, 0.02)], "target_id long, plan_name string, source string, layer string, target_share double, min_rows int, sample_share double")
    made = proportions.ProportionalSample(df, targets)
    share = made._drawn()["p"] / 600
    assert abs(share[0] - 0.75) < 0.06 and share.sum() == 1
    assert [r.drawn for r in made.report().orderBy("target_id").collect()] == [450, 150]


def _queue(spark, budget_share):
    """The mixture as a plain loop over all copies in order of finish time."""
    from orebody.functions.columns import source_category
    from orebody.llm._util import unit_draw

    read = lambda t: spark.read.parquet(f"{SMALL}/{t}.parquet")
    tokens = mixing.token_counts(read("documents")).select("*", unit_draw(mixing.SEED, "doc_id").alias("u")).collect()
    targets = {r.s: (r.target_share, r.max_repeats) for r in read("mix_targets").select(source_category().alias("s"), "target_share", "max_repeats").collect()}
    copies = []
    for s, (weight, repeats) in targets.items():
        done = 0
        for turn in range(1, repeats + 1):
            for r in sorted((r for r in tokens if r.source == s), key=lambda r: (r.u, r.doc_id)):
                done += r.tokens
                copies.append((done / weight, s, turn, r.doc_id, r.tokens))
    out, total, budget = [], 0, budget_share * sum(r.tokens for r in tokens)
    for finish, s, turn, doc, n in sorted(copies):
        total += n
        if total > budget:
            break
        out.append((doc, s, turn, n))
    return read, out


@pytest.mark.parametrize("budget_share", [0.4, 0.05, 5.0])
def test_mixture_is_the_sequential_queue(spark, budget_share):
    read, want = _queue(spark, budget_share)
    made = mixing.Mixture(read("documents"), read("mix_targets"), budget_share)
    assert sorted((r.doc_id, r.source, r["pass"], r.tokens) for r in made.used.collect()) == sorted(want)
    report = made.report().collect()
    total = sum(w[3] for w in want)
    for r in report:
        assert r.used_tokens == sum(w[3] for w in want if w[1] == r.source) and abs(r.actual_share - r.used_tokens / total) < 1e-9


def test_virtual_time_of_a_budget():
    assert mixing.spent_at(10, [(0.5, 100.0), (0.5, 100.0)]) == 10
    assert mixing.spent_at(10, [(0.5, 2.0), (0.5, 100.0)]) == 16
    assert mixing.spent_at(10, [(0.5, 2.0), (0.5, 3.0)]) == float("inf")


def _kneser_ney(texts):
    """Perplexities by modified Kneser-Ney in plain Python, each occurrence left out of what judges it."""
    from collections import Counter, defaultdict

    from orebody.functions.text import words

    docs = [words(t) for t in texts]
    tri = Counter(tuple(d[i : i + 3]) for d in docs for i in range(len(d) - 2))
    left2 = Counter((b, c) for _, b, c in tri)
    left1 = Counter(c for _, c in left2)
    d3, d2, d1 = (repetition.discounts(np.array([sum(v == i for v in n.values()) for i in (1, 2, 3, 4)])) for n in (tri, left2, left1))
    off = lambda n, d: (0.0, *d)[min(n, 3)]
    context2, context1 = defaultdict(list), defaultdict(list)
    for (a, b, _), n in tri.items():
        context2[a, b].append(n)
    for (b, _), n in left2.items():
        context1[b].append(n)
    vocabulary, all_left = len(left1), sum(left1.values())
    unseen = sum(off(n, d1) for n in left1.values()) / all_left / vocabulary
    left_out = lambda n, d, total: (n - 1 - off(n - 1, d)) / max(total - 1, 1)
    weight = lambda ns, d: sum(off(n, d) for n in ns) / sum(ns) if sum(ns) > 1 else 1.0
    out = []
    for d in docs:
        logs = []
        for a, b, c in (d[i : i + 3] for i in range(len(d) - 2)):
            one = (left1[c] - off(left1[c], d1)) / all_left + unseen
            two = left_out(left2[b, c], d2, sum(context1[b])) + weight(context1[b], d2) * one
            logs.append(np.log(left_out(tri[a, b, c], d3, sum(context2[a, b])) + weight(context2[a, b], d3) * two))
        out.append(float(np.exp(-np.mean(logs))) if logs else None)
    return out


def test_perplexity_is_kneser_ney(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()
    want = dict(zip([r.doc_id for r in docs], _kneser_ney([r.text for r in docs])))
    found = {r.doc_id: r.perplexity for r in repetition.measured(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert found.keys() == want.keys()
    for i, p in want.items():
        assert (p is None) == (found[i] is None) and (p is None or abs(found[i] - p) < 1e-4 * p), i


def test_languages_are_found_from_words(spark):
    """Labels that are wrong or missing don't decide."""
    en, de = "the river and the stone were under the old bridge of the town", "der fluss und der stein waren unter der alten brücke in der stadt"
    rows = [(i, f"{en if i % 2 else de} {i}", ("en" if i % 2 else "de")) for i in range(200)] + [(900, de + " 7", "en"), (901, en + " 8", None), (902, None, "en"), (903, "", "de")]
    tokens = repetition.token_batches(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    found = {r.doc_id: r.lang for r in repetition.languages(tokens).collect()}
    assert [found[i] for i in (0, 1, 900, 901, 902, 903)] == ["de", "en", "de", "en", "und", "und"]


def test_bands_hold_the_repetitive(spark):
    """The band is fitted on a part of the documents; of all repetitive ones at least nine in ten lie under it, and others don't."""
    scores = repetition.measured(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).cache()
    under = {r.doc_id for r in repetition.low_band(scores, fit_documents=400).collect()}
    known = {r.doc_id: r.repeated_share >= 0.3 for r in scores.where("n_words >= 30").collect()}
    repetitive = {i for i, yes in known.items() if yes}
    assert len(repetitive) >= 20 and len(repetitive & under) >= 0.9 * len(repetitive) and len(under) < len(known)
    plain = scores.where("repeated_share < 0.3")
    assert repetition.low_band(plain).count() == plain.where("n_words >= 30").count()


def test_the_band_holds_repetitive_documents_that_a_sample_would_miss(spark):
    """Of 60,000 documents one in 4,000 is repetitive, each more perplexing than the one before."""
    scores = spark.range(60_000).selectExpr("id as doc_id", "'en' as lang", "100L as n_words", "if(id % 4000 = 7, 0.5D, 0.0D) as repeated_share", "exp(if(id % 4000 = 7, id / 4000, id % 100 / 50D)) as perplexity")
    found = {r.doc_id for r in repetition.low_band(scores).where("repeated_share >= 0.3").collect()}
    assert found == set(range(7, 60_000, 4_000))


def test_hits_are_compared_by_words():
    index = leakage.PassageIndex([1], [" ".join(f"w{i}" for i in range(14))])
    assert index._contains("x " + " ".join(f"W{i}" for i in range(2, 14)) + ".", 1) and not index._contains(" ".join(f"w{i}" for i in range(11)), 1)


def test_recall_of_pruned_lists(spark):
    """Lists of 64 rows, so that most are pruned: nine in ten pairs of similarity 0.95 among the best five are found, and few others."""
    d = "/root/testdata/sf0.01"
    ids, x = _usable(spark, d)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = {(min(int(ids[q]), int(ids[j])), max(int(ids[q]), int(ids[j]))) for q in range(len(ids)) for j in np.lexsort((ids, -s[q]))[:5] if s[q, j] >= 0.95}
    index = neighbours.VectorIndex(spark.read.parquet(f"{d}/points.parquet"), list_rows=64)
    found = {(min(r.id, r.neighbour), max(r.id, r.neighbour)) for r in index.neighbours(5, min_similarity=0.95).collect()}
    assert index.lists > 40 and len(found & want) >= 0.9 * len(want) and len(found - want) <= 0.02 * len(found)
