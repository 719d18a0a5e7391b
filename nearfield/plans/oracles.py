"""The registered queries as SQL over the supplied tables.

Written for checking only: plain definitions, no shared code with the engine.
Statements are assembled from named common table expressions.
"""

from __future__ import annotations

from nearfield.plans.registry import (
    ACCURACY,
    CAP,
    COARSE,
    COARSE_PROBES,
    DEGREE,
    DIM,
    EF,
    ENTRIES,
    EPSILON,
    FULL,
    HOPS,
    K,
    LISTS,
    OVERFETCH,
    PROBES,
    PROBES_CODES,
    QUERIES,
    ROWS_PER_LIST,
    SEED_ROUNDS,
    SHIFT,
)

PRUNE_ALPHA = 1.2

BUCKETS = {"thermo4": 4, "thermo8": 8, "onehot4": 4, "onehot8": 8}


def _with(*parts: str) -> str:
    """A WITH clause of the given expressions, each once, in order."""
    return "WITH " + ",\n".join(dict.fromkeys(parts)) + "\n"


def _micro(vec: str) -> str:
    return f"array_to_string(list_transform({vec}, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT)), ',')"


def _half_units(vec: str) -> str:
    return f"array_to_string(list_transform({vec}, lambda x: CAST(x * 16777216 AS BIGINT)), ',')"


def _rounded(value: str, digits: int = 6) -> str:
    """Rounded, with a plain zero for both signed zeros."""
    return f"CASE WHEN round({value}, {digits}) = 0 THEN 0.0 ELSE round({value}, {digits}) END"


def _bits(vec: str) -> str:
    return f"array_to_string({vec}, '')"


def _norm(vec: str) -> str:
    return f"sqrt(list_dot_product({vec}, {vec}))"


def _cosine(a: str, b: str) -> str:
    return f"1.0 - list_dot_product({a}, {b}) / ({_norm(a)} * {_norm(b)})"


def _differ(a: str, b: str) -> str:
    """Differing bits of two 0/1 lists of doubles."""
    return f"list_dot_product({a}, {a}) + list_dot_product({b}, {b}) - 2 * list_dot_product({a}, {b})"


def _top(source: str, key: str, order: str, k: int, columns: str) -> str:
    """The k first rows per key with their rank."""
    return (
        f"(SELECT {columns}, CAST(rk AS INTEGER) AS rk FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY {key} ORDER BY {order}) AS rk FROM {source}) WHERE rk <= {k})"
    )


def _hashed(seed: str, key: str = "vec_id") -> str:
    return f"md5('{seed}|' || {key})"


RAW = "raw AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL)"
UNIT = f"unit AS (SELECT vec_id, list_transform(e, lambda x: x / n) AS v FROM (SELECT vec_id, e, {_norm('e')} AS n FROM raw) WHERE n > 0)"
PICKED = f"picked AS (SELECT vec_id FROM raw ORDER BY {_hashed('query')}, vec_id LIMIT {QUERIES})"


def _sliced(dim: int) -> str:
    if dim == FULL:
        return "p AS (SELECT vec_id, v FROM unit)"
    return (
        f"p AS (SELECT vec_id, list_transform(s, lambda x: x / n) AS v FROM "
        f"(SELECT vec_id, s, {_norm('s')} AS n FROM (SELECT vec_id, v[1:{dim}] AS s FROM unit)) WHERE n > 0)"
    )


def _f32(vec: str) -> str:
    return f"list_transform({vec}, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE))"


def _f16(vec: str) -> str:
    """Half rounding in arithmetic: the spacing of halves around each value."""
    step = "pow(2.0, greatest(floor(log2(abs(x))), -14) - 10)"
    return f"list_transform({vec}, lambda x: CASE WHEN x = 0 THEN 0.0 ELSE round_even(x / {step}, 0) * {step} END)"


def _floats(precision: str) -> str:
    made = _f32("v") if precision == "f32" else _f16("v")
    return f"items AS (SELECT vec_id, {made} AS f FROM p)"


CUTS = (
    "spread AS (SELECT d, list_extract(v, CAST(d + 1 AS INTEGER)) AS x FROM unit, unnest(range(len(v))) AS r(d))",
    "cuts AS (SELECT d, avg(x) AS m, "
    + ", ".join(f"quantile_cont(x, {i / 8}) AS q{i}" for i in range(1, 8))
    + " FROM spread GROUP BY d)",
    "thresholds AS (SELECT list(m ORDER BY d) AS ms, list([q2, q4, q6] ORDER BY d) AS t4, "
    "list([q1, q2, q3, q4, q5, q6, q7] ORDER BY d) AS t8 FROM cuts)",
)


def _code_list(variant: str, dim: int) -> str:
    """0/1 list of a vector ``v``, with ``thresholds`` in scope."""
    dims = f"range(1, {dim + 1})"
    if variant == "sign":
        return "list_transform(v, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)"
    if variant == "mean":
        return f"list_transform({dims}, lambda d: CASE WHEN v[d] >= ms[d] THEN 1 ELSE 0 END)"
    width, cuts = BUCKETS[variant], f"t{variant[-1]}"
    reached = f"lambda j: CASE WHEN v[d] >= {cuts}[d][j] THEN 1 ELSE 0 END"
    passed = f"list_transform(range(1, {width}), {reached})"
    if variant.startswith("thermo"):
        return f"flatten(list_transform({dims}, lambda d: list_append({passed}, 0)))"
    bucket = f"CAST(list_sum({passed}) AS BIGINT)"
    return f"flatten(list_transform({dims}, lambda d: list_transform(range({width}), lambda b: CASE WHEN b = {bucket} THEN 1 ELSE 0 END)))"


def _codes(*variants: str, dim: int) -> str:
    made = ", ".join(f"{_code_list(v, dim)} AS c_{v}" for v in variants)
    return f"coded AS MATERIALIZED (SELECT vec_id, v, {made} FROM p, thresholds)"


def _code_items(variant: str, precision: str = "f32") -> str:
    """(vec_id, f, c): floats and the code as doubles."""
    made = _f32("v") if precision == "f32" else _f16("v")
    return (
        f"items AS MATERIALIZED (SELECT vec_id, {made} AS f, "
        f"list_transform(c_{variant}, lambda b: CAST(b AS DOUBLE)) AS c FROM coded)"
    )


ASKED_F = "asked AS (SELECT vec_id AS qid, f AS qf FROM items WHERE vec_id IN (SELECT vec_id FROM picked))"
ASKED_C = "asked AS (SELECT vec_id AS qid, f AS qf, c AS qc FROM items WHERE vec_id IN (SELECT vec_id FROM picked))"


def _base(dim: int) -> tuple[str, ...]:
    return (RAW, UNIT, PICKED, _sliced(dim))


def _hits(source: str, k: int = K) -> str:
    top = _top(source, "qid", "dist, vec_id", k, "qid, vec_id, dist")
    return f"SELECT qid, rk, vec_id, {_rounded('dist')} AS dist FROM {top}"


def _exact(dim: int, precision: str) -> tuple[str, ...]:
    pairs = f"pairs AS (SELECT qid, vec_id, {_cosine('f', 'qf')} AS dist FROM asked, items)"
    return (*_base(dim), _floats(precision), ASKED_F, pairs)


def _coded(variant: str, dim: int, precision: str = "f32") -> tuple[str, ...]:
    return (*_base(dim), *CUTS, _codes(variant, dim=dim), _code_items(variant, precision), ASKED_C)


def _reranked(candidates: str) -> str:
    return (
        f"final AS (SELECT c.qid, c.vec_id, {_cosine('i.f', 'a.qf')} AS dist FROM {candidates} c "
        f"JOIN items i ON i.vec_id = c.vec_id JOIN asked a ON a.qid = c.qid)"
    )


def _rerank(variant: str, precision: str) -> str:
    pairs = f"pairs AS (SELECT qid, vec_id, {_differ('c', 'qc')} AS dist FROM asked, items)"
    best = _top("pairs", "qid", "dist, vec_id", K * OVERFETCH, "qid, vec_id")
    return _with(*_coded(variant, DIM, precision), pairs, f"best AS {best}", _reranked("best")) + _hits("final")


def _hamming(variant: str) -> str:
    pairs = f"pairs AS (SELECT qid, vec_id, {_differ('c', 'qc')} AS dist FROM asked, items)"
    top = _top("pairs", "qid", "dist, vec_id", K, "qid, vec_id, dist")
    return _with(*_coded(variant, FULL), pairs) + (
        f"SELECT qid, rk, vec_id, CAST(dist AS INTEGER) AS dist FROM {top}"
    )


# --- inverted lists ------------------------------------------------------------------


def _seeds(what: str = "f") -> str:
    order = f"{_hashed('centroid')}, vec_id"
    return (
        f"seeds AS (SELECT CAST(row_number() OVER (ORDER BY {order}) - 1 AS INTEGER) AS list_id, {what} AS cen "
        f"FROM items ORDER BY {order} LIMIT {LISTS})"
    )


def _assign(name: str, centres: str, distance: str) -> str:
    top = _top(
        f"(SELECT vec_id, list_id, {distance} AS dist FROM items, {centres})",
        "vec_id",
        "dist, list_id",
        1,
        "vec_id, list_id",
    )
    return f"{name} AS MATERIALIZED (SELECT vec_id, list_id FROM {top})"


def _probed(centres: str, distance: str, probes: int) -> str:
    top = _top(
        f"(SELECT qid, list_id, {distance} AS dist FROM asked, {centres})", "qid", "dist, list_id", probes, "qid, list_id"
    )
    return f"probed AS MATERIALIZED {top}"


LLOYD = (
    "means AS (SELECT list_id, d, avg(list_extract(f, CAST(d + 1 AS INTEGER))) AS mean FROM assigned0 "
    "JOIN items USING (vec_id), unnest(range(len(f))) AS r(d) GROUP BY list_id, d)",
    "moved AS (SELECT list_id, list(mean ORDER BY d) AS g FROM means GROUP BY list_id)",
    f"centres AS MATERIALIZED (SELECT s.list_id, CASE WHEN g IS NULL THEN cen ELSE "
    f"list_transform(g, lambda x: x / {_norm('g')}) END AS cen FROM seeds s LEFT JOIN moved USING (list_id))",
)

MAJORITY = (
    "votes AS (SELECT list_id, d, count(*) AS n, sum(list_extract(c, CAST(d + 1 AS INTEGER))) AS s FROM assigned0 "
    "JOIN items USING (vec_id), unnest(range(len(c))) AS r(d) GROUP BY list_id, d)",
    "moved AS (SELECT list_id, list(CASE WHEN 2 * s >= n THEN 1.0 ELSE 0.0 END ORDER BY d) AS g FROM votes GROUP BY list_id)",
    "centres AS MATERIALIZED (SELECT s.list_id, coalesce(g, cen) AS cen FROM seeds s LEFT JOIN moved USING (list_id))",
)


def _ivf(precision: str) -> str:
    near = _cosine("f", "cen")
    pairs = (
        f"pairs AS (SELECT qid, vec_id, {_cosine('f', 'qf')} AS dist FROM probed JOIN asked USING (qid) "
        f"JOIN assigned USING (list_id) JOIN items USING (vec_id))"
    )
    return _with(
        *_base(FULL),
        _floats(precision),
        ASKED_F,
        _seeds(),
        _assign("assigned0", "seeds", near),
        *LLOYD,
        _assign("assigned", "centres", near),
        _probed("centres", _cosine("qf", "cen"), PROBES),
        pairs,
    ) + _hits("pairs")


def _seed_parallel() -> str:
    """Two rounds of oversampling: rows drawn by hash where it lies below their share of all distances."""
    first = f"(SELECT vec_id FROM items ORDER BY {_hashed('parallel')}, vec_id LIMIT 1)"
    parts = [f"centres0 AS MATERIALIZED (SELECT vec_id, f AS cen, 0 AS found_in, '' AS draw FROM items WHERE vec_id = {first})"]
    for turn in range(1, SEED_ROUNDS + 1):
        seed = _hashed(f"parallel{turn}", "i.vec_id")
        share = f"CAST('0x' || substr({seed}, 1, 8) AS BIGINT) / 4294967296.0"
        near = f"min({_cosine('i.f', 'c.cen')})"
        parts += [
            f"left{turn} AS MATERIALIZED (SELECT vec_id, CASE WHEN dist < 1e-9 THEN 0.0 ELSE dist END AS dist FROM "
            f"(SELECT i.vec_id, {near} AS dist FROM items i, centres{turn - 1} c GROUP BY i.vec_id))",
            f"centres{turn} AS MATERIALIZED (SELECT * FROM centres{turn - 1} UNION ALL SELECT i.vec_id, i.f, {turn}, {seed} "
            f"FROM items i JOIN left{turn} l USING (vec_id) WHERE {share} < l.dist / (SELECT sum(dist) FROM left{turn}) * {2.0 * LISTS} "
            f"AND i.vec_id NOT IN (SELECT vec_id FROM centres{turn - 1}))",
        ]
    return _with(
        *_base(FULL),
        f"items AS MATERIALIZED (SELECT vec_id, {_f32('v')} AS f FROM p)",
        *parts,
        f"seeds AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY found_in, draw, vec_id) - 1 AS INTEGER) AS list_id, vec_id AS seed_id, cen, "
        f"found_in FROM centres{SEED_ROUNDS})",
        _assign("assigned", "seeds", _cosine("f", "cen")),
    ) + (
        "SELECT s.list_id, s.seed_id AS vec_id, CAST(s.found_in AS INTEGER) AS found_in, count(a.vec_id) AS n FROM seeds s LEFT JOIN assigned a "
        "ON a.list_id = s.list_id GROUP BY s.list_id, s.seed_id, s.found_in"
    )


def _two_level() -> tuple[str, ...]:
    """Rows under the nearest fine centroid of their nearest coarse one."""
    near = _cosine("f", "cen")
    least = _top("hashed", "list_id", "h, vec_id", 1, "list_id, vec_id")
    return (
        *_base(FULL),
        _floats("f32"),
        ASKED_F,
        _seeds().replace(f"LIMIT {LISTS}", f"LIMIT {COARSE}"),
        _assign("coarse", "seeds", near),
        f"sizes AS (SELECT list_id, count(*) AS n, CAST(ceil(count(*) / {ROWS_PER_LIST}.0) AS BIGINT) AS m FROM coarse GROUP BY list_id)",
        "hashed AS (SELECT vec_id, list_id, CAST('0x' || substr(md5('fine|' || vec_id), 1, 8) AS BIGINT) AS h FROM coarse)",
        f"least AS (SELECT list_id, vec_id FROM {least})",
        "fine AS MATERIALIZED (SELECT h.list_id AS coarse_id, h.vec_id AS fine_id, i.f AS fc FROM hashed h JOIN sizes s USING (list_id) "
        "JOIN items i ON i.vec_id = h.vec_id LEFT JOIN least l ON l.list_id = h.list_id AND l.vec_id = h.vec_id "
        "WHERE h.h < (s.m * 4294967296) // s.n OR l.vec_id IS NOT NULL)",
        "met AS (SELECT c.vec_id, c.list_id AS coarse_id, fine_id, " + _cosine("i.f", "fc") + " AS dist FROM coarse c "
        "JOIN items i ON i.vec_id = c.vec_id JOIN fine ON fine.coarse_id = c.list_id)",
        f"assigned AS MATERIALIZED (SELECT vec_id, coarse_id, fine_id AS list_id FROM {_top('met', 'vec_id', 'dist, fine_id', 1, 'vec_id, coarse_id, fine_id')})",
    )


def _two_level_knn() -> str:
    asked_fine = (
        f"(SELECT qid, fine_id, {_cosine('qf', 'fc')} AS dist FROM probed JOIN asked USING (qid) JOIN fine ON fine.coarse_id = probed.list_id)"
    )
    return _with(
        *_two_level(),
        _probed("seeds", _cosine("qf", "cen"), COARSE_PROBES),
        f"looked AS MATERIALIZED (SELECT qid, fine_id AS list_id FROM {_top(asked_fine, 'qid', 'dist, fine_id', PROBES, 'qid, fine_id')})",
        f"pairs AS (SELECT qid, vec_id, {_cosine('f', 'qf')} AS dist FROM looked JOIN asked USING (qid) "
        f"JOIN assigned USING (list_id) JOIN items USING (vec_id))",
    ) + _hits("pairs")


def _code_lists(variant: str, precision: str = "f32") -> tuple[str, ...]:
    near = _differ("c", "cen")
    return (
        *_coded(variant, FULL, precision),
        _seeds("c"),
        _assign("assigned0", "seeds", near),
        *MAJORITY,
        _assign("assigned", "centres", near),
    )


def _ivf_rerank(variant: str, precision: str) -> str:
    pairs = (
        f"pairs AS (SELECT qid, vec_id, {_differ('c', 'qc')} AS dist FROM probed JOIN asked USING (qid) "
        f"JOIN assigned USING (list_id) JOIN items USING (vec_id))"
    )
    best = _top("pairs", "qid", "dist, vec_id", K * OVERFETCH, "qid, vec_id")
    return _with(
        *_code_lists(variant, precision),
        _probed("centres", _differ("qc", "cen"), PROBES_CODES),
        pairs,
        f"best AS {best}",
        _reranked("best"),
    ) + _hits("final")


# --- RaBitQ --------------------------------------------------------------------------

_UNIT_OF = "list_transform({0}, lambda x: x / " + _norm("{0}") + ")"


def _offset(a: str, b: str) -> str:
    return f"list_transform(range(1, {FULL + 1}), lambda d: {a}[d] - {b}[d])"


def _turned(name: str, source: str, keys: str) -> str:
    """Rotated unit offsets: signs drawn by hash, then the Hadamard rows."""
    return (
        f"{name}_rows AS (SELECT {keys}, r, CASE WHEN n < 1e-9 THEN 0.0 ELSE n END AS n FROM "
        f"(SELECT {keys}, r, {_norm('r')} AS n FROM {source})),\n"
        f"{name} AS MATERIALIZED (SELECT {keys}, n, list(CASE WHEN n = 0 THEN 0.0 ELSE list_dot_product(r, hrow) / n END "
        f"ORDER BY i) AS t FROM {name}_rows, hadamard GROUP BY {keys}, n)"
    )


HADAMARD = (
    f"signs AS (SELECT list(CASE WHEN CAST('0x' || substr(md5('sign|' || d), 1, 8) AS BIGINT) % 2 = 1 THEN 1.0 ELSE -1.0 END ORDER BY d) AS sg FROM range({FULL}) AS r(d))",
    f"hadamard AS MATERIALIZED (SELECT i, list_transform(range({FULL}), lambda d: CASE WHEN bit_count(i & d) % 2 = 0 THEN sg[d + 1] ELSE -sg[d + 1] END / sqrt({FULL}.0)) AS hrow FROM range({FULL}) AS r(i), signs)",
)


def _rabitq_base(precision: str = "f32") -> tuple[str, ...]:
    stored = _f32("v") if precision == "f32" else _f16("v")
    unit_items = f"items AS MATERIALIZED (SELECT vec_id, f, {_UNIT_OF.format('f')} AS u FROM (SELECT vec_id, {stored} AS f FROM p))"
    return (
        *_base(FULL),
        unit_items,
        "asked AS (SELECT vec_id AS qid, f AS qf, u AS qu FROM items WHERE vec_id IN (SELECT vec_id FROM picked))",
        _seeds(),
        _assign("assigned", "seeds", _cosine("f", "cen")),
        f"units AS MATERIALIZED (SELECT list_id, {_UNIT_OF.format('cen')} AS cu FROM seeds)",
        *HADAMARD,
        f"res AS (SELECT vec_id, list_id, {_offset('u', 'cu')} AS r FROM assigned JOIN items USING (vec_id) JOIN units USING (list_id))",
        _turned("turned", "res", "vec_id, list_id"),
        f"coded AS MATERIALIZED (SELECT vec_id, list_id, n, list_transform(t, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits, "
        f"list_transform(t, lambda x: CASE WHEN x > 0 THEN 1.0 ELSE -1.0 END) AS sgn, "
        f"CASE WHEN n = 0 THEN 1.0 ELSE list_sum(list_transform(t, lambda x: abs(x))) / sqrt({FULL}.0) END AS dot FROM turned)",
    )


def _rabitq_scored(precision: str = "f32") -> tuple[str, ...]:
    return (
        *_rabitq_base(precision),
        _probed("seeds", _cosine("qf", "cen"), PROBES),
        f"qres AS (SELECT qid, list_id, {_offset('qu', 'cu')} AS r FROM probed JOIN asked USING (qid) JOIN units USING (list_id))",
        _turned("qturned", "qres", "qid, list_id"),
        f"scored AS MATERIALIZED (SELECT q.qid, c.vec_id, (c.n * c.n + q.n * q.n - 2 * c.n * q.n * list_dot_product(c.sgn, q.t) / sqrt({FULL}.0) / c.dot) / 2 AS est, "
        f"c.n * q.n * {EPSILON} * sqrt(greatest(1 - c.dot * c.dot, 0) / (c.dot * c.dot)) / sqrt({FULL - 1}.0) AS err "
        f"FROM qturned q JOIN coded c USING (list_id))",
    )


def _rabitq_estimate() -> str:
    return _with(*_rabitq_scored(), "pairs AS (SELECT qid, vec_id, round(est, 12) AS dist FROM scored)") + _hits("pairs")


def _rabitq_planes() -> tuple[str, ...]:
    """Scores of queries rounded to 16 levels between their least and largest element."""
    low, step = "list_min(t)", "(list_max(t) - list_min(t)) / 15.0"
    kept = "list_transform(t, lambda x: low + step * floor((x - low) / step + 0.5))"
    moved = "list_sum(list_transform(list_zip(t, kept), lambda p: abs(p[1] - p[2])))"
    alone = f"(sqrt({FULL}.0) * c.dot)"
    return (
        *_rabitq_scored()[:-1],
        f"levels AS (SELECT *, {low} AS low, CASE WHEN {step} = 0 THEN 1.0 ELSE {step} END AS step FROM qturned)",
        f"kepts AS (SELECT *, {kept} AS kept FROM levels)",
        f"planes AS MATERIALIZED (SELECT *, {moved} AS moved FROM kepts)",
        f"scored AS MATERIALIZED (SELECT q.qid, c.vec_id, (c.n * c.n + q.n * q.n - 2 * c.n * q.n * list_dot_product(c.sgn, q.kept) / {alone}) / 2 AS est, "
        f"c.n * q.n * ({EPSILON} * sqrt(greatest(1 - c.dot * c.dot, 0) / (c.dot * c.dot)) / sqrt({FULL - 1}.0) + q.moved / {alone}) AS err "
        f"FROM planes q JOIN coded c USING (list_id))",
    )


def _rabitq_knn(precision: str = "f32", scored: tuple[str, ...] | None = None) -> str:
    kth = _top("(SELECT qid, vec_id, est + err AS up FROM scored)", "qid", "up, vec_id", K, "qid, up")
    return _with(
        *(scored or _rabitq_scored(precision)),
        f"kth AS (SELECT qid, up FROM {kth} WHERE rk = {K})",
        f"pairs AS (SELECT s.qid, s.vec_id, {_cosine('i.f', 'a.qf')} AS dist FROM scored s LEFT JOIN kth USING (qid) "
        f"JOIN items i ON i.vec_id = s.vec_id JOIN asked a ON a.qid = s.qid WHERE kth.up IS NULL OR s.est - s.err <= kth.up)",
    ) + _hits("pairs")


# --- neighbour graphs ----------------------------------------------------------------


def _links(distance: str) -> tuple[str, ...]:
    """Exact neighbours both ways, the nearest 2 x DEGREE of each row kept."""
    there = _top(
        f"(SELECT a.vec_id AS src, b.vec_id AS dst, {distance} AS dist FROM items a, items b WHERE a.vec_id <> b.vec_id)",
        "src",
        "dist, dst",
        DEGREE,
        "src, dst, dist",
    )
    both = "(SELECT src, dst, min(dist) AS dist FROM (SELECT src, dst, dist FROM there UNION ALL SELECT dst, src, dist FROM there) GROUP BY src, dst)"
    return (
        f"there AS MATERIALIZED {there}",
        f"links AS MATERIALIZED {_top(both, 'src', 'dist, dst', 2 * DEGREE, 'src, dst')}",
    )


def _beam(distance: str, width: int) -> tuple[str, ...]:
    """Entry rows, then HOPS rounds of opening every unopened row of the beam."""
    entries = f"(SELECT vec_id FROM items ORDER BY {_hashed('entry')}, vec_id LIMIT {ENTRIES})"
    start = f"(SELECT qid, vec_id, {distance} AS dist, false AS opened FROM asked, items WHERE vec_id IN {entries})"
    parts = [f"beam0 AS MATERIALIZED {_top(start, 'qid', 'dist, vec_id', width, 'qid, vec_id, dist, opened')}"]
    for hop in range(HOPS):
        parts.append(
            f"fresh{hop} AS MATERIALIZED (SELECT DISTINCT b.qid, l.dst AS vec_id FROM beam{hop} b JOIN links l ON l.src = b.vec_id "
            f"WHERE NOT b.opened AND NOT EXISTS (SELECT 1 FROM beam{hop} o WHERE o.qid = b.qid AND o.vec_id = l.dst))"
        )
        pool = (
            f"(SELECT qid, vec_id, dist, true AS opened FROM beam{hop} UNION ALL SELECT qid, vec_id, {distance} AS dist, "
            f"false AS opened FROM fresh{hop} JOIN items USING (vec_id) JOIN asked USING (qid))"
        )
        parts.append(
            f"beam{hop + 1} AS MATERIALIZED {_top(pool, 'qid', 'dist, vec_id', width, 'qid, vec_id, dist, opened')}"
        )
    return tuple(parts)


def _graph_knn() -> str:
    return _with(
        *_base(FULL), _floats("f32"), ASKED_F, *_links(_cosine("a.f", "b.f")), *_beam(_cosine("f", "qf"), EF)
    ) + _hits(f"beam{HOPS}")


def _graph_rerank(variant: str, precision: str) -> str:
    return _with(
        *_coded(variant, FULL, precision),
        *_links(_differ("a.c", "b.c")),
        *_beam(_differ("c", "qc"), K * OVERFETCH),
        _reranked(f"beam{HOPS}"),
    ) + _hits("final")


def _graph_exact() -> str:
    top = _top(
        f"(SELECT a.vec_id AS src, b.vec_id AS dst, {_cosine('a.f', 'b.f')} AS dist FROM items a, items b WHERE a.vec_id <> b.vec_id)",
        "src",
        "dist, dst",
        DEGREE,
        "src, dst",
    )
    return _with(RAW, UNIT, _sliced(FULL), _floats("f32")) + f"SELECT src, dst, rk FROM {top}"


def _blocked_edges(probes: int = PROBES, precision: str = "f32") -> tuple[str, ...]:
    near = _cosine("f", "cen")
    looked = _top(
        f"(SELECT vec_id, list_id, {near} AS dist FROM items, seeds)", "vec_id", "dist, list_id", probes, "vec_id, list_id"
    )
    top = _top(
        f"(SELECT l.vec_id AS src, t.vec_id AS dst, {_cosine('a.f', 'b.f')} AS dist FROM looked l "
        f"JOIN assigned t USING (list_id) JOIN items a ON a.vec_id = l.vec_id JOIN items b ON b.vec_id = t.vec_id "
        f"WHERE l.vec_id <> t.vec_id)",
        "src",
        "dist, dst",
        DEGREE,
        "src, dst, dist",
    )
    return (
        *(RAW, UNIT, _sliced(FULL), _floats(precision), _seeds()),
        _assign("assigned", "seeds", near),
        f"looked AS {looked}",
        f"near AS MATERIALIZED {top}",
    )


def _graph_blocked(precision: str = "f32") -> str:
    return _with(*_blocked_edges(precision=precision)) + "SELECT src, dst, rk FROM near"


def _graph_refined() -> str:
    """Rows linked to one row become candidates of each other, once."""
    both = "(SELECT src, dst, min(dist) AS dist FROM (SELECT src, dst, dist FROM near UNION ALL SELECT dst, src, dist FROM near) GROUP BY src, dst)"
    links = f"links AS MATERIALIZED {_top(both, 'src', 'dist, dst', 2 * DEGREE, 'src, dst')}"
    pairs = (
        "pairs AS (SELECT DISTINCT a.dst AS src, b.dst AS dst FROM links a JOIN links b USING (src) WHERE a.dst <> b.dst "
        "UNION SELECT src, dst FROM links)"
    )
    scored = f"(SELECT p.src, p.dst, {_cosine('a.f', 'b.f')} AS dist FROM pairs p JOIN items a ON a.vec_id = p.src JOIN items b ON b.vec_id = p.dst)"
    return _with(*_blocked_edges(2), links, pairs) + (
        f"SELECT src, dst, rk FROM {_top(scored, 'src', 'dist, dst', DEGREE, 'src, dst')}"
    )


def _alpha_rule(near: str, many: int) -> tuple[str, ...]:
    """flagged (src, dst, spot): a neighbour is kept unless an earlier kept one lies ALPHA times closer to it."""
    listed = (
        "listed AS MATERIALIZED (SELECT n.src, list(n.dst ORDER BY n.rk) AS dsts, list(n.dist ORDER BY n.rk) AS ds, "
        f"list(i.f ORDER BY n.rk) AS fs FROM {near} n JOIN items i ON i.vec_id = n.dst GROUP BY n.src)"
    )
    steps = []
    for i in range(1, many + 1):
        source = "listed" if i == 1 else f"keep{i - 1}"
        covered = " OR ".join(
            f"(k{j} AND {PRUNE_ALPHA} * ({_cosine(f'fs[{j}]', f'fs[{i}]')}) <= ds[{i}])" for j in range(1, i)
        )
        steps.append(
            f"keep{i} AS MATERIALIZED (SELECT *, len(dsts) >= {i} AND NOT coalesce({covered or 'false'}, false) AS k{i} FROM {source})"
        )
    flags = ", ".join(f"k{i}" for i in range(1, many + 1))
    rows = (
        f"flagged AS (SELECT src, dsts[spot] AS dst, spot FROM (SELECT src, dsts, [{flags}] AS flags FROM keep{many}), "
        f"unnest(range(1, {many + 1})) AS r(spot) WHERE flags[spot])"
    )
    return listed, *steps, rows


def _graph_pruned() -> str:
    return _with(*_blocked_edges(), *_alpha_rule("near", DEGREE)) + (
        "SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY spot) AS INTEGER) AS rk FROM flagged"
    )


def _graph_two_sided() -> str:
    """The rule over links both ways, of which it keeps DEGREE."""
    ways = "ways AS (SELECT src, dst, min(dist) AS dist FROM (SELECT src, dst, dist FROM near UNION ALL SELECT dst, src, dist FROM near) GROUP BY src, dst)"
    wide = f"wide AS MATERIALIZED {_top('ways', 'src', 'dist, dst', 2 * DEGREE, 'src, dst, dist')}"
    return _with(*_blocked_edges(), ways, wide, *_alpha_rule("wide", 2 * DEGREE)) + (
        "SELECT src, dst, rk FROM (SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY spot) AS INTEGER) AS rk FROM flagged) "
        f"WHERE rk <= {DEGREE}"
    )


# --- small statements ----------------------------------------------------------------

LABEL_TABLES = (
    "stored AS (SELECT 'items_' || label AS table_name, 'embeddings' AS data_source, count(*) AS num_vectors, "
    f"{DIM} AS dimension, 'thermometer' AS encoder, label FROM embeddings GROUP BY label)"
)


def _markdown() -> str:
    parts, rows = [RAW, UNIT, PICKED], []
    parts.append(f"full_f AS (SELECT vec_id, {_f32('v')} AS f FROM unit)")
    truth = _top(
        "(SELECT a.vec_id AS qid, b.vec_id, -list_dot_product(a.f, b.f) AS dist FROM full_f a, full_f b "
        "WHERE a.vec_id IN (SELECT vec_id FROM picked))",
        "qid",
        "dist, vec_id",
        K,
        "qid, vec_id",
    )
    parts.append(f"truth AS MATERIALIZED {truth}")
    for dim in (16, DIM, FULL):
        sliced = _sliced(dim).replace("p AS", f"p{dim} AS", 1)
        parts.append(sliced)
        for precision, storage, width in (("f32", "float32", 4), ("f16", "float16", 2)):
            name = f"{precision}_{dim}"
            made = _f32("v") if precision == "f32" else _f16("v")
            parts.append(f"i_{name} AS (SELECT vec_id, {made} AS f FROM p{dim})")
            best = _top(
                f"(SELECT a.vec_id AS qid, b.vec_id, {_cosine('a.f', 'b.f')} AS dist FROM i_{name} a, i_{name} b "
                "WHERE a.vec_id IN (SELECT vec_id FROM picked))",
                "qid",
                "dist, vec_id",
                K,
                "qid, vec_id",
            )
            parts.append(f"b_{name} AS {best}")
            rows.append(
                f"SELECT {dim} AS dimension, '{storage}' AS storage, '| exact | ' || "
                f"printf('%.1f', 100.0 * (SELECT count(*) FROM b_{name} JOIN truth USING (qid, vec_id)) / (SELECT count(*) FROM truth)) || "
                f"' | 0.00 | {dim} | {storage} | 0.00 | ' || "
                f"printf('%.1f', (SELECT count(*) FROM raw) * {dim} * {width} * 1.1 / 1048576) || ' | 0.0 |' AS line"
            )
    return _with(*parts) + "\nUNION ALL\n".join(rows)


def _config_grid() -> str:
    cells = [(m, p, None, 0) for m, ps in {"rabitq": 2, "ivf": 2, "graph_pruned": 1, "graph": 2, "exact": 2}.items() for p in (4, 2)[:ps]]
    cells += [
        (m, p, v, b)
        for m in ("graph_rerank", "ivf_rerank", "exact_rerank")
        for v, b in (("mean", 1), ("thermo8", 8), ("thermo4", 4))
        for p in (4, 2)
    ]
    values = ", ".join(f"('{m}', {p}, {'NULL' if v is None else repr(v)}, {b})" for m, p, v, b in cells)
    return (
        f"SELECT CAST(d AS INTEGER) AS dimension, method, CASE width WHEN 4 THEN 'float32' ELSE 'float16' END AS storage, "
        f"CAST(variant AS VARCHAR) AS variant, n AS num_vectors, "
        f"round(CAST(n AS DOUBLE) * d * width * 1.1 / 1048576, 6) AS storage_mb, "
        f"round(CAST(n AS DOUBLE) * d * bits / 8 * 1.1 / 1048576, 6) AS code_mb "
        f"FROM (VALUES {values}) AS c(method, width, variant, bits), (VALUES (16), ({DIM}), ({FULL})) AS s(d), "
        f"(SELECT count(embedding) AS n FROM embeddings)"
    )


def _recall_cell(dim: int, precision: str, method: str, variant: str | None) -> str:
    """One row of the recall grid: mean share of the full-width neighbours found."""
    if method == "exact":
        final = f"final AS (SELECT qid, vec_id, {_cosine('f', 'qf')} AS dist FROM asked, items)"
        parts = (*_base(dim), _floats(precision), ASKED_F, final)
    else:
        pairs = f"pairs AS (SELECT qid, vec_id, {_differ('c', 'qc')} AS dist FROM asked, items)"
        parts = _coded(variant, dim, precision)
        if method == "ivf_rerank":
            parts = (
                *parts,
                _seeds("c"),
                _assign("assigned", "seeds", _differ("c", "cen")),
                _probed("seeds", _differ("qc", "cen"), PROBES_CODES),
            )
            pairs = (
                f"pairs AS (SELECT qid, vec_id, {_differ('c', 'qc')} AS dist FROM probed JOIN asked USING (qid) "
                f"JOIN assigned USING (list_id) JOIN items USING (vec_id))"
            )
        best = _top("pairs", "qid", "dist, vec_id", K * OVERFETCH, "qid, vec_id")
        parts = (*parts, pairs, f"best AS {best}", _reranked("best"))
    whole = f"whole AS (SELECT vec_id, {_f32('v')} AS g FROM unit)"
    true = _top(
        "(SELECT q.vec_id AS qid, w.vec_id, -list_dot_product(q.g, w.g) AS dist FROM whole q, whole w WHERE q.vec_id IN (SELECT vec_id FROM picked))",
        "qid",
        "dist, vec_id",
        K,
        "qid, vec_id",
    )
    hits = _top("final", "qid", "dist, vec_id", K, "qid, vec_id")
    one = _with(*parts, whole, f"truth AS {true}", f"hits AS {hits}") + (
        "SELECT avg(share) AS recall FROM (SELECT t.qid, avg(CASE WHEN h.vec_id IS NULL THEN 0.0 ELSE 1.0 END) AS share FROM truth t "
        "LEFT JOIN hits h ON h.qid = t.qid AND h.vec_id = t.vec_id GROUP BY t.qid)"
    )
    storage = {"f32": "float32", "f16": "float16"}[precision]
    name = "NULL" if variant is None else f"'{variant}'"
    return (
        f"SELECT CAST({dim} AS INTEGER) AS dimension, '{storage}' AS storage, '{method}' AS method, "
        f"CAST({name} AS VARCHAR) AS variant, round(recall, 6) AS recall FROM ({one})"
    )


def _recall_grid() -> str:
    cells = [("exact", None)] + [(m, v) for m in ("exact_rerank", "ivf_rerank") for v in ("mean", "thermo8", "thermo4")]
    return "\nUNION ALL\n".join(
        _recall_cell(dim, precision, *cell) for dim in (16, DIM, FULL) for cell in cells for precision in ("f32", "f16")
    )


def _ivf_params() -> str:
    within = "least(greatest({0}, {1}), {2})"
    lists = within.format("n // 200", 50, 500)
    probes = (
        f"CASE WHEN k <= 200 THEN {within.format('round_even(lists / 16, 0)', 8, 40)} "
        f"ELSE {within.format('round_even(lists / 12, 0)', 10, 50)} END"
    )
    coded = f"CASE WHEN k <= 200 THEN {within.format('probes * 3', 24, 120)} ELSE {within.format('probes * 3', 30, 200)} END"
    return (
        f"SELECT CAST(part AS BIGINT) AS part, n, k, CAST(lists AS INTEGER) AS lists, CAST(probes AS INTEGER) AS probes, "
        f"CAST({coded} AS INTEGER) AS probes_codes, CAST(least(greatest(1500, k), 1000) AS INTEGER) AS search_width FROM "
        f"(SELECT *, {probes} AS probes FROM (SELECT *, {lists} AS lists FROM "
        f"(SELECT l_linenumber AS part, count(*) AS n FROM lineitem GROUP BY l_linenumber), (VALUES (10), (100), (1000)) AS a(k)))"
    )


def _gen_vectors() -> str:
    def uniform(start: int) -> str:
        return f"((CAST('0x' || substr(md5('gauss|' || vec_id || '|' || d), {start}, 8) AS BIGINT) + 1) / 4294967297.0)"

    draw = f"sqrt(-2.0 * ln({uniform(1)})) * cos(2.0 * pi() * {uniform(9)})"
    return (
        f"WITH g AS (SELECT vec_id, list_transform(range(16), lambda d: {draw}) AS e FROM embeddings) "
        f"SELECT vec_id, {_micro(_UNIT_OF.format('e'))} AS v FROM g"
    )


def _pair(kind: str) -> str:
    one = f"one AS (SELECT * FROM items ORDER BY {_hashed('query')}, vec_id LIMIT 1)"
    if kind == "hamming_distance":
        value, base = _differ("i.c", "one.c"), (*_base(DIM), *CUTS, _codes("thermo4", dim=DIM), _code_items("thermo4"))
        value = f"CAST({value} AS INTEGER)"
    else:
        base = (*_base(DIM), _floats("f32"))
        value = _cosine("i.f", "one.f") if kind == "cosine_distance" else "list_dot_product(i.f, one.f)"
        value = _rounded(value)
    return _with(*base, one) + f"SELECT i.vec_id, {value} AS value FROM items i, one"


def _one_query(precision: str) -> str:
    one = f"one AS (SELECT * FROM items ORDER BY {_hashed('query')}, vec_id LIMIT 1)"
    return _with(*_base(DIM), _floats(precision), one) + (
        f"SELECT vec_id, {_rounded('dist')} AS dist FROM (SELECT i.vec_id, {_cosine('i.f', 'one.f')} AS dist FROM items i, one) "
        f"ORDER BY dist, vec_id LIMIT {K}"
    )


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["load_vectors"] = (
        "SELECT count(*) AS num_vectors, count(*) FILTER (embedding IS NULL) AS null_vectors, "
        "CAST(min(len(embedding)) AS INTEGER) AS min_width, CAST(max(len(embedding)) AS INTEGER) AS max_width, "
        "count(*) FILTER (len(list_filter(embedding, lambda x: x IS NULL)) > 0) AS with_null_element FROM embeddings"
    )
    sql["cap_rows"] = f"SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT {CAP}"
    sql["gen_vectors"] = _gen_vectors()
    sql["assign_ids"] = (
        f"SELECT vec_id, row_number() OVER (ORDER BY {_hashed('order')}) - 1 AS row_id FROM embeddings"
    )
    four = ("sign", "mean", "thermo4", "thermo8")
    sql["unified_table"] = _with(RAW, UNIT, _sliced(DIM), *CUTS, _codes(*four, dim=DIM)) + (
        f"SELECT vec_id, {_micro(_f32('v'))} AS f32, {_half_units(_f16('v'))} AS f16, "
        + ", ".join(f"{_bits(f'c_{v}')} AS code_{v}" for v in four)
        + " FROM coded"
    )
    sql["single_precision_table"] = _with(RAW, UNIT, _sliced(DIM), *CUTS, _codes("thermo4", dim=DIM)) + (
        f"SELECT vec_id, {_half_units(_f16('v'))} AS embedding, {_bits('c_thermo4')} AS code_thermo4 FROM coded"
    )
    sql["single_precision_table_vector"] = _with(RAW, UNIT, _sliced(DIM), *CUTS, _codes("sign", dim=DIM)) + (
        f"SELECT vec_id, {_micro(_f32('v'))} AS embedding, {_bits('c_sign')} AS code_sign FROM coded"
    )
    sql["metadata_upsert"] = _with(LABEL_TABLES) + (
        "SELECT table_name, data_source, num_vectors, CAST(CASE WHEN num_vectors > (SELECT avg(num_vectors) FROM stored) "
        f"THEN {FULL} ELSE dimension END AS INTEGER) AS dimension, encoder FROM stored"
    )
    sql["cache_check"] = _with(LABEL_TABLES) + (
        "SELECT table_name, label <> (SELECT max(label) FROM stored) AND label <> (SELECT min(label) FROM stored) AS cached FROM stored"
    )
    sql["table_check"] = (
        "SELECT column_name, present, n AS num_rows, present AS usable FROM (VALUES ('f32', true), ('code_sign', true), "
        "('code_thermo8', false)) AS c(column_name, present), (SELECT count(embedding) AS n FROM embeddings)"
    )
    sql["table_build_cached"] = _with(RAW, UNIT, *CUTS[:1]) + (
        ", centre AS (SELECT d, avg(x) AS m FROM spread GROUP BY d), ones AS (SELECT count(DISTINCT vec_id) AS n, "
        "CAST(sum(CASE WHEN x >= m THEN 1 ELSE 0 END) AS BIGINT) AS plain, "
        f"CAST(sum(CASE WHEN x >= m + {SHIFT} THEN 1 ELSE 0 END) AS BIGINT) AS shifted FROM "
        "(SELECT vec_id, d, list_extract(v, CAST(d + 1 AS INTEGER)) AS x FROM unit, unnest(range(len(v))) AS r(d)) JOIN centre USING (d)) "
        "SELECT step, built, n AS num_vectors, CASE WHEN moved THEN shifted ELSE plain END AS ones FROM ones, "
        "(VALUES ('build', true, false), ('again', false, false), ('shifted', true, true), ('forced', true, true)) AS s(step, built, moved)"
    )
    labelled = "labelled AS (SELECT vec_id, v, label, label = (SELECT min(label) FROM raw) AS low, label = (SELECT max(label) FROM raw) AS high FROM unit JOIN raw USING (vec_id))"
    positive = "len(list_filter(v, lambda x: x > 0))"
    negative = "len(list_filter(v, lambda x: x < 0))"
    sql["table_delta_build"] = _with(RAW, UNIT, labelled) + (
        "SELECT CAST(1 AS INTEGER) AS version, count(*) AS num_vectors, count(*) AS encoded, CAST(0 AS BIGINT) AS removed, "
        f"CAST(sum(CASE WHEN low THEN {negative} ELSE {positive} END) AS BIGINT) AS ones FROM labelled WHERE NOT high UNION ALL "
        "SELECT CAST(2 AS INTEGER), count(*), count(*) FILTER (low OR high), count(*) FILTER (low AND NOT high), "
        f"CAST(sum({positive}) AS BIGINT) FROM labelled"
    )
    sql["table_drop_versions"] = _with(RAW, UNIT, labelled) + (
        "SELECT CAST(version AS INTEGER) AS version, version = 3 AS kept, CASE WHEN version = 3 THEN n ELSE 0 END AS num_vectors "
        "FROM range(1, 4) AS r(version), (SELECT count(*) AS n FROM labelled WHERE NOT low)"
    )
    words = {"f32": DIM * 4, "f16": DIM * 2, "code_sign": 8, "code_mean": 8, "code_thermo4": DIM * 4 // 8, "code_thermo8": DIM}
    sql["index_size"] = (
        "SELECT representation, n AS num_rows, n * width AS bytes FROM (VALUES "
        + ", ".join(f"('{name}', {width})" for name, width in words.items())
        + ") AS c(representation, width), (SELECT count(embedding) AS n FROM embeddings)"
    )
    sql["results_markdown"] = _markdown()
    sql["sample_queries"] = (
        f"SELECT vec_id, label FROM embeddings ORDER BY {_hashed('query')}, vec_id LIMIT {QUERIES}"
    )
    sql["config_grid"] = _config_grid()
    sql["l2_normalize"] = _with(RAW, UNIT) + f"SELECT vec_id, {_micro('v')} AS v FROM unit"
    padded = f"list_concat(e, list_transform(range({96 - FULL}), lambda i: 0.0))"
    sql["pad_truncate"] = _with(RAW) + f"SELECT vec_id, {_micro(padded)} AS padded, {_micro('e[1:48]')} AS truncated FROM raw"
    sql["matryoshka_slice"] = _with(RAW, UNIT, _sliced(16)) + f"SELECT vec_id, {_micro('v')} AS v FROM p"
    sql["to_half"] = _with(RAW, UNIT, _sliced(DIM)) + f"SELECT vec_id, {_half_units(_f16('v'))} AS f16 FROM p"
    for variant in ("sign", "mean", "thermo4", "thermo8", "onehot4", "onehot8"):
        sql[f"code_{variant}"] = _with(RAW, UNIT, _sliced(FULL), *CUTS, _codes(variant, dim=FULL)) + (
            f"SELECT vec_id, {_bits(f'c_{variant}')} AS code FROM coded"
        )
    sql["bits_to_string"] = _with(RAW, UNIT, _sliced(FULL), *CUTS, _codes("thermo4", dim=FULL)) + (
        f"SELECT vec_id, {_bits('c_thermo4')} AS bits, CAST(list_sum(c_thermo4) AS BIGINT) AS ones, true AS same FROM coded"
    )
    sql["vector_text_roundtrip"] = f"SELECT vec_id, true AS same, {_micro('embedding')} AS v FROM embeddings"
    for kind in ("cosine_distance", "inner_product", "hamming_distance"):
        sql[kind] = _pair(kind)
    sql["benchmark_recall"] = _recall_grid()
    sql["ivf_params"] = _ivf_params()
    mb = "round(CAST(n AS DOUBLE) * dims * {0} * 1.1 / 1048576, 9)"
    sql["storage_estimate"] = (
        f"SELECT label, n, {mb.format(4)} AS f32_mb, {mb.format(2)} AS f16_mb, {mb.format('1 / 8')} AS code1_mb, "
        f"{mb.format('4 / 8')} AS code4_mb, {mb.format(1)} AS code8_mb FROM (SELECT label, count(*) AS n, "
        "max(len(embedding)) AS dims FROM embeddings GROUP BY label)"
    )
    sql["dim_means"] = _with(RAW, UNIT, *CUTS) + f"SELECT CAST(d AS INTEGER) AS d, {_rounded('m', 9)} AS mean FROM cuts"
    sql["dim_percentiles"] = _with(RAW, UNIT, *CUTS) + (
        f"SELECT CAST(d AS INTEGER) AS d, CAST(j - 1 AS INTEGER) AS cut, {_rounded('[q1, q2, q3, q4, q5, q6, q7][j]', 9)} AS eighth, "
        f"{_rounded('[q2, q4, q6][j]', 9)} AS quarter FROM cuts, unnest(range(1, 8)) AS r(j)"
    )
    sql["dim_percentiles_two_pass"] = sql["dim_percentiles"]
    discrete = ", ".join(f"quantile_disc(x, {i / 8})" for i in range(1, 8))
    sql["dim_percentiles_approx"] = _with(RAW, UNIT, CUTS[0]) + (
        f"SELECT CAST(d AS INTEGER) AS d, CAST(j - 1 AS INTEGER) AS cut, {_rounded('qs[j]', 9)} AS value FROM "
        f"(SELECT d, [{discrete}] AS qs FROM spread GROUP BY d), unnest(range(1, 8)) AS r(j)"
    )
    slack = f"CAST(ceil(n / {ACCURACY}.0) AS BIGINT)"
    lowest = f"greatest(0, CAST(floor((c + 1) * n / 8.0) AS BIGINT) - {slack} - 1)"
    highest = f"least(n - 1, CAST(ceil((c + 1) * n / 8.0) AS BIGINT) + {slack})"
    # That the approximate value lies between these two is what is promised.
    sql["dim_percentiles_rank_error"] = _with(
        RAW,
        UNIT,
        CUTS[0],
        "ranked AS (SELECT d, x, row_number() OVER (PARTITION BY d ORDER BY x) - 1 AS place, count(*) OVER (PARTITION BY d) AS n FROM spread)",
        f"ends AS (SELECT d, c, min(x) FILTER (place = {lowest}) AS lo, min(x) FILTER (place = {highest}) AS hi FROM ranked, range(7) AS r(c) GROUP BY d, c)",
    ) + (
        f"SELECT CAST(d AS INTEGER) AS d, CAST(c AS INTEGER) AS cut, {_rounded('lo')} AS lowest, {_rounded('hi')} AS highest, true AS within FROM ends"
    )
    truth = _top("(SELECT qid, vec_id, -list_dot_product(f, qf) AS dist FROM asked, items)", "qid", "dist, vec_id", K, "qid, vec_id")
    found = _top(f"(SELECT qid, vec_id, {_differ('c', 'qc')} AS dist FROM asked, items)", "qid", "dist, vec_id", K, "qid, vec_id")
    sql["recall_at_k"] = _with(*_coded("thermo4", FULL), f"truth AS {truth}", f"found AS {found}") + (
        "SELECT t.qid, round(avg(CASE WHEN f.vec_id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall FROM truth t "
        "LEFT JOIN found f ON f.qid = t.qid AND f.vec_id = t.vec_id GROUP BY t.qid"
    )
    best = _top(
        "(SELECT q.vec_id AS qid, u.vec_id, list_dot_product(q.v, u.v) AS dot FROM unit q, unit u WHERE q.vec_id IN (SELECT vec_id FROM picked))",
        "qid",
        "dot DESC, vec_id",
        K,
        "qid, vec_id, dot",
    )
    sql["ground_truth"] = _with(RAW, UNIT, PICKED) + f"SELECT qid, rk, vec_id, {_rounded('dot')} AS dot FROM {best}"
    for precision in ("f32", "f16"):
        sql[f"exact_knn_{precision}"] = _one_query(precision)
        sql[f"ivf_knn_{precision}"] = _ivf(precision)
    sql["exact_knn_batch"] = _with(*_exact(FULL, "f32")) + _hits("pairs")
    for variant in four:
        sql[f"hamming_topk_{variant}"] = _hamming(variant)
        for precision in ("f32", "f16"):
            sql[f"rerank_{variant}_{precision}"] = _rerank(variant, precision)
            sql[f"ivf_rerank_{variant}_{precision}"] = _ivf_rerank(variant, precision)
            if variant != "sign":
                sql[f"graph_rerank_{variant}_{precision}"] = _graph_rerank(variant, precision)
        # A stored index answers as the one it was written from.
        sql[f"ivf_stored_rerank_{variant}_f32"] = sql[f"ivf_rerank_{variant}_f32"]
    for precision in ("f32", "f16"):
        sql[f"ivf_stored_knn_{precision}"] = sql[f"ivf_knn_{precision}"]
    sql["hamming_topk_onehot8"] = _hamming("onehot8")
    sql["hamming_topk_radius"] = sql["hamming_topk_thermo4"]
    sql["hamming_mih_knn"] = sql["hamming_topk_sign"]
    sql["exact_knn_certified"] = sql["exact_knn_batch"]
    sql["ivf_two_level_assign"] = _with(*_two_level()) + "SELECT vec_id, coarse_id, list_id FROM assigned"
    sql["ivf_two_level_knn"] = _two_level_knn()
    seeded = (RAW, UNIT, _sliced(FULL), _floats("f32"), _seeds(), _assign("assigned0", "seeds", _cosine("f", "cen")))
    sql["ivf_assign_seeded"] = _with(*seeded) + "SELECT vec_id, list_id FROM assigned0"
    sql["ivf_lloyd_step"] = _with(*seeded, LLOYD[0]) + (
        f"SELECT list_id, CAST(d AS INTEGER) AS d, {_rounded('mean')} AS mean FROM means"
    )
    sql["ivf_code_assign"] = _with(*_code_lists("thermo4")) + "SELECT vec_id, list_id FROM assigned"
    sql["rerank_late_f32"] = _rerank("thermo8", "f32")
    sql["ivf_seed_parallel"] = _seed_parallel()
    sql["rabitq_encode"] = _with(*_rabitq_base()) + (
        f"SELECT vec_id, list_id, {_bits('bits')} AS code, {_rounded('n')} AS norm, {_rounded('dot')} AS dot FROM coded"
    )
    sql["rabitq_estimate"] = _rabitq_estimate()
    sql["rabitq_knn"] = _rabitq_knn()
    sql["rabitq_knn_f16"] = _rabitq_knn("f16")
    sql["rabitq_bits_knn"] = _rabitq_knn(scored=_rabitq_planes())
    sql["knn_graph_exact"] = _graph_exact()
    sql["knn_graph_blocked"] = _graph_blocked()
    sql["knn_graph_blocked_f16"] = _graph_blocked("f16")
    sql["knn_graph_refined"] = _graph_refined()
    sql["knn_graph_pruned"] = _graph_pruned()
    sql["knn_graph_two_sided"] = _graph_two_sided()
    sql["graph_knn"] = _graph_knn()
    return sql
