"""Plain SQL for the registered queries, written from the definitions and independent of
the Spark plans: quadratic self-joins, full windows and unrolled steps."""

from __future__ import annotations

from outvote.plans.queries import INNE_SUBSPACES, MEASURES, VOTERS

# Each feature table: (name, id column, feature columns, SQL).
PROFILE_COLS = ["n_orders", "total_price", "mean_price", "top_price"]
SOURCES = {
    "profile": (
        "o_custkey",
        PROFILE_COLS,
        """select o_custkey, cast(count(*) as double) as n_orders,
             round(cast(sum(cast(o_totalprice as decimal(18,2))) as double), 6) as total_price,
             round(cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(*), 6) as mean_price,
             round(max(o_totalprice), 6) as top_price
           from orders group by o_custkey""",
    ),
    "events2": (
        "event_id",
        ["value", "hour_of_day"],
        "select event_id, value, cast(extract(hour from ts) as double) as hour_of_day from events",
    ),
    "events1": ("event_id", ["value"], "select event_id, value from events"),
    "lines": (None, MEASURES, f"select {', '.join(MEASURES)} from lineitem"),
    "parts": (
        "p_partkey",
        ["p_size", "p_retailprice"],
        "select p_partkey, cast(p_size as double) as p_size, p_retailprice from part",
    ),
    "docs": (
        "doc_id",
        ["n_chars", "n_spaces"],
        """select doc_id, cast(n_chars as double) as n_chars,
             cast(length(text) - length(replace(text, ' ', '')) as double) as n_spaces from documents""",
    ),
    "emb8": (
        "vec_id",
        [f"e{i}" for i in range(8)],
        "select vec_id, " + ", ".join(f"cast(embedding[{i + 1}] as double) as e{i}" for i in range(8)) + " from embeddings",
    ),
    "emb64": (
        "vec_id",
        [f"e{i}" for i in range(64)],
        "select vec_id, " + ", ".join(f"cast(embedding[{i + 1}] as double) as e{i}" for i in range(64)) + " from embeddings",
    ),
    "orders2": (
        "o_orderkey",
        ["o_totalprice", "day"],
        """select o_orderkey, o_totalprice,
             cast(date_diff('day', date '1992-01-01', cast(o_orderdate as date)) as double) as day from orders""",
    ),
    "accounts": (
        "c_custkey",
        ["c_acctbal", "c_nationkey"],
        "select c_custkey, c_acctbal, cast(c_nationkey as double) as c_nationkey from customer",
    ),
}


def source(name: str) -> tuple[str | None, list[str], str]:
    """(id column, feature columns, CTEs `f` and `c` = row count)."""
    key, cols, sql = SOURCES[name]
    return key, cols, f"f as ({sql}), c as (select count(*) as n from f)"


def scaled_source(name: str) -> tuple[str, list[str], str]:
    key, cols, sql = SOURCES[name]
    stats = ", ".join(f"avg({x}) as m_{x}, stddev_pop({x}) as s_{x}" for x in cols)
    parts = ", ".join(f"({x} - m_{x}) / case when s_{x} > 0 then s_{x} else 1 end as {x}" for x in cols)
    return key, cols, f"raw as ({sql}), st as (select {stats} from raw), f as (select {key}, {parts} from raw, st), c as (select count(*) as n from f)"


def significant(x: str) -> str:
    """Equal sums must tie in any order of adding, so sums are compared by 40 of their bits
    (a number less a multiple of itself), at any scale."""
    return f"(({x}) * cast(8193 as double) - (({x}) * cast(8193 as double) - ({x})))"


def shown(score: str) -> str:
    """Six digits of a score: rounded where it is shown, and nowhere before."""
    return f"round({score}, 6)"


def flag_tail(columns: str, scored: str = "s", level: str | None = None) -> str:
    """Final select over a CTE with `score`: strictly above the 95th percentile, or above the
    score at a computed level."""
    if level is not None:
        return (
            f"select {columns}, {shown('score')} as score, score > (select score from (select score, row_number() over (order by score) as r, "
            f"count(*) over () as n from {scored}) where r = cast(floor((n - 1) * {level}) as bigint) + 1) as is_outlier from {scored}"
        )
    return (
        f"select {columns}, {shown('score')} as score, "
        f"score > (select quantile_cont(score, 0.95) from {scored}) as is_outlier from {scored}"
    )


def by_name(parts_sql: str) -> str:
    """A query over parts, its key as text."""
    return f"select printf('part %09d', p_partkey) as part_id, score, is_outlier from ({parts_sql})"


# ---- one CTE chain per statistical detector; each ends in a table with `score` ----


def zscore_ctes(name: str, p: str, guarded: bool = True) -> tuple[str, str]:
    key, cols, _ = source(name)
    stats = ", ".join(
        f"avg({x}) as m_{x}, stddev_pop({x}) as s_{x}, max(abs({x} - (select avg({x}) from f))) as r_{x}" for x in cols
    )
    if guarded:
        terms = [
            f"case when s_{x} < 1e-10 or r_{x} / (abs(m_{x}) + 1e-10) < 1e-12 then 0 else abs(({x} - m_{x}) / s_{x}) end"
            for x in cols
        ]
    else:
        terms = [f"case when s_{x} = 0 then 0 else abs(({x} - m_{x}) / s_{x}) end" for x in cols]
    score = terms[0] if len(terms) == 1 else f"greatest({', '.join(terms)})"
    return f"{p}st as (select {stats} from f), {p}s as (select f.*, {score} as score from f, {p}st)", f"{p}s"


def hbos_ctes(name: str, p: str, own_bin: bool = False) -> tuple[str, str]:
    key, cols, _ = source(name)
    parts = [f"{p}b as (select greatest(5, least(50, cast(floor(log2(n)) as int) + 1)) as b from c)"]
    row = "rowid_"
    parts.append(f"{p}r as (select row_number() over () as {row}, f.* from f)")
    terms = []
    for i, x in enumerate(cols):
        parts.append(
            f"{p}g{i} as (select case when min({x}) = max({x}) then min({x}) - 0.5 else min({x}) end as lo, "
            f"case when min({x}) = max({x}) then max({x}) + 0.5 else max({x}) end as hi from f)"
        )
        parts.append(
            f"{p}e{i} as (select i, case when i = b then hi else lo + i * ((hi - lo) / b) end as e "
            f"from {p}g{i}, {p}b, range(0, (select b from {p}b) + 1) t(i))"
        )
        parts.append(
            f"{p}v{i} as (select v, least((select count(*) from {p}e{i} where e <= v) - 1, b - 1) as own, "
            f"least((select count(*) from {p}e{i} where e < v and i < b), b - 1) as nxt "
            f"from (select distinct {x} as v from f), {p}b)"
        )
        parts.append(
            f"{p}h{i} as (select a.i as bin, greatest(coalesce(k, 0) / (n * (z.e - a.e)), 1e-6) as p "
            f"from {p}e{i} a join {p}e{i} z on z.i = a.i + 1 left join "
            f"(select own, count(*) as k from f join {p}v{i} on {x} = v group by own) on own = a.i, c)"
        )
        terms.append(f"-ln(h{i}.p)")
    joins = " ".join(
        f"join {p}v{i} v{i} on v{i}.v = r.{x} join {p}h{i} h{i} on h{i}.bin = v{i}.{'own' if own_bin else 'nxt'}"
        for i, x in enumerate(cols)
    )
    parts.append(f"{p}s as (select r.*, {significant(' + '.join(terms))} as score from {p}r r {joins})")
    return ", ".join(parts), f"{p}s"


def copod_ctes(name: str, p: str) -> tuple[str, str]:
    key, cols, _ = source(name)
    ranks = ", ".join(
        f"(rank() over (order by {x}) + (count(*) over (partition by {x}) - 1) / 2.0) / (n + 1.0) as f_{x}" for x in cols
    )
    total = " + ".join(
        f"greatest(-ln(f_{x} + 1.0 / (n + 1.0)), -ln(1.0 - f_{x} + 1.0 / (n + 1.0)))" for x in cols
    )
    return (
        f"{p}r as (select f.*, n, {ranks} from f, c), "
        f"{p}t as (select *, {significant(total)} as raw from {p}r), "
        f"{p}m as (select median(raw) as med from {p}t), "
        f"{p}a as (select median(abs(raw - med)) as mad from {p}t, {p}m), "
        f"{p}s as (select * exclude (n), (raw - med) / case when mad = 0 then 1 else mad end as score from {p}t, {p}m, {p}a)",
        f"{p}s",
    )


def ecod_ctes(name: str, p: str) -> tuple[str, str]:
    key, cols, _ = source(name)
    ranks = ", ".join(f"cume_dist() over (order by {x}) as f_{x}" for x in cols)
    mean = " + ".join(f"-ln(least(f_{x}, 1 - f_{x}) + 1e-10)" for x in cols)
    return (
        f"{p}r as (select f.*, {ranks} from f), "
        f"{p}s as (select *, exp({significant(f'({mean}) / {len(cols)}.0')}) as score from {p}r)",
        f"{p}s",
    )


def statistical(name: str, ctes, level: str | None = None, **settings) -> str:
    key, cols, base = source(name)
    chain, scored = ctes(name, "x_", **settings)
    return f"with {base}, {chain} {flag_tail(key or ', '.join(cols), scored, level)}"


# ---- neighbours ------------------------------------------------------------------

KNN_K = "least(n, greatest(least(n, 20), least(40, cast(floor(ln(n) * 2) as int))))"
LOF_K = "least(n - 1, greatest(least(n, 20), least(50, cast(floor(ln(n) * 3) as int))))"


def ranked_pairs(key: str, cols: list[str], tied: bool = False) -> str:
    """CTEs: `p` = rows with the smallest id among equal rows, `o` = other rows by rank."""
    dist = " + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in cols)
    dist = significant(f"sqrt({dist})") if tied else f"sqrt({dist})"
    return (
        f"p as (select {key} as id, {', '.join(cols)}, min({key}) over (partition by {', '.join(cols)}) as rep from f), "
        f"d as (select a.id, b.id as nid, b.rep as nrep, {dist} as dist from p a join p b on a.id <> b.id), "
        "o as (select *, row_number() over (partition by id order by dist, nrep, nid) as r from d)"
    )


def knn(name: str, k: str = KNN_K) -> str:
    key, cols, base = source(name)
    return (
        f"with {base}, {ranked_pairs(key, cols)}, "
        f"s as (select id as {key}, dist as score from o, c where r = {k} - 1) {flag_tail(key)}"
    )


def lof(name: str) -> str:
    key, cols, base = source(name)
    return f"""with {base}, {ranked_pairs(key, cols)}, k as (select {LOF_K} as k from c),
      kd as (select id, dist as kdist from o, k where r = k),
      lrd as (select o.id, 1 / (avg(greatest(o.dist, kd.kdist)) + 1e-10) as lrd
              from o join kd on kd.id = o.nid, k where r <= k group by o.id),
      s as (select o.id as {key}, {significant('avg(b.lrd) / max(a.lrd)')} as score
            from o join lrd b on b.id = o.nid join lrd a on a.id = o.id, k where r <= k group by o.id)
      {flag_tail(key)}"""


def dbscan(name: str) -> str:
    """Cores and noise by counting rows in reach, once per radius; the first that fits."""
    key, cols, base = scaled_source(name)
    radii = " union all ".join(
        f"select {i} as i, quantile_cont(dist, {q}) as eps from kd" for i, q in enumerate((0.80, 0.85, 0.90, 0.95, 0.98), 1)
    )
    return f"""with {base}, {ranked_pairs(key, cols, True)},
      h as (select greatest(20, least(50, cast(floor(sqrt(n)) as int))) as nn,
                   greatest(5, least(20, cast(floor(n * 0.005) as int))) as ms from c),
      kd as (select id, dist from o, h where r = nn - 1),
      eps as ({radii}),
      near as (select i, id, nid from d, eps where dist <= eps),
      core as (select i, id from near, h group by i, id, ms having count(*) + 1 >= ms),
      safe as (select i, id from core union select near.i, near.id from near join core on core.i = near.i and core.id = near.nid),
      noise as (select i, p.id, not exists (select 1 from safe where safe.i = eps.i and safe.id = p.id) as noisy from p, eps),
      rate as (select i, avg(cast(noisy as int)) as rate from noise group by i),
      pick as (select coalesce(min(i) filter (where abs(rate - 0.05) < 0.1 or rate <= 0.05 * 2), 5) as i from rate),
      coredist as (select id, dist from o, h where r = ms - 1),
      reach as (select d.id, min(greatest(d.dist, k.dist)) as reach from o d join coredist k on k.id = d.nid, h
                where d.r <= nn - 1 group by d.id)
      select noise.id as {key}, {shown('least(coredist.dist, reach.reach)')} as score, noisy as is_outlier
      from noise join pick on pick.i = noise.i join coredist on coredist.id = noise.id join reach on reach.id = noise.id"""


def neighbours(name: str, k: int) -> str:
    key, cols, base = source(name)
    return (
        f"with {base}, {ranked_pairs(key, cols)} select id as {key}, cast(r as int) as place, nrep as neighbour, "
        f"round(dist, 6) as dist from o where r <= {k}"
    )


def inne(name: str) -> str:
    """Five rounds of 256 rows, disjoint chunks of one seeded order: needs 1,280 rows."""
    key, cols, base = scaled_source(name)
    parts = []
    for i, subset in enumerate(INNE_SUBSPACES):
        dist = " + ".join(f"(f.{cols[j]} - t.{cols[j]}) * (f.{cols[j]} - t.{cols[j]})" for j in subset)
        parts.append(
            f"select {i} as i, f.{key} as id, sqrt({dist}) as dist from f join train t on t.at = {i}"
        )
    return f"""with {base},
      train as (select f.*, (row_number() over (order by md5(cast({key} as varchar) || ':0'), {key}) - 1) // 256 as at from f),
      d as ({' union all '.join(parts)}),
      o as (select *, row_number() over (partition by i, id order by dist) as r from d),
      m as (select i, id, avg(dist) as m from o, c where r <= greatest(1, least(10, cast(floor(ln(n)) as int))) group by i, id),
      s as (select id as {key}, {significant('avg(m)')} as score from m group by id) {flag_tail(key)}"""


def hex_share(text: str, begin: int, digits: int) -> str:
    """Some hexadecimal digits of a text as a number from 0 to 1."""
    each = f"list_transform(string_split(substr({text}, {begin}, {digits}), ''), lambda ch: cast(instr('0123456789abcdef', ch) - 1 as double))"
    return f"list_reduce(list_prepend(cast(0 as double), {each}), lambda a, b: a * 16 + b) / power(16, {digits})"


def hashed_rounds(key: str, size: int, rounds: str) -> str:
    """CTEs: `rounds` samples of `size` rows, chunks of one seeded order after another."""
    return f"""rounds as (select cast({rounds} as bigint) as rounds from c),
      passes as (select rounds, greatest(1, least(n, rounds * {size}) // {size}) as chunks from c, rounds),
      ranked as (select f.*, p, row_number() over (partition by p order by
          md5(cast({key} as varchar) || ':0' || case when p > 0 then ':' || p else '' end), cast({key} as varchar)) - 1 as place
        from f, passes, range(0, cast((rounds - 1) // chunks + 1 as bigint)) r(p)),
      sampled as (select t.round, ranked.* exclude (p, place) from passes, range(0, cast(rounds as bigint)) t(round), ranked
        where p = t.round // chunks and place // {size} = t.round % chunks)"""


def path_length(count: str) -> str:
    return (
        f"case when {count} <= 1 then 0 when {count} = 2 then 1 "
        f"else 2.0 * (ln({count} - 1.0) + 0.5772156649015329) - 2.0 * ({count} - 1.0) / {count} end"
    )


def forest(name: str, trees: str, size: int = 256, height: int = 8) -> tuple[str, str]:
    """(id column, CTEs up to `s` with `score`): trees grown level by level from md5 draws,
    then every row walked down every tree."""
    key, cols, base = source(name)
    d = len(cols)
    xs = "[" + ", ".join(f"cast({x} as double)" for x in cols) + "]"
    parts = [f"with {base}, {hashed_rounds(key, size, trees)}", f"s0 as (select round as tree, {xs} as xs, 0 as node from sampled)"]
    for k in range(height + 1):
        lows = ", ".join(f"min(xs[{j + 1}])" for j in range(d))
        highs = ", ".join(f"max(xs[{j + 1}])" for j in range(d))
        parts.append(f"st{k} as (select tree, node, count(*) as cnt, [{lows}] as lo, [{highs}] as hi from s{k} group by tree, node)")
        if k == height:
            parts.append(f"leaf{k} as (select tree, node, {k} + {path_length('cnt')} as depth from st{k})")
            break
        text = "md5('0:' || tree || ':' || node)"
        parts.append(
            f"""v{k} as (select *, list_filter(range(1, {d + 1}), lambda j: lo[j] < hi[j]) as vary from st{k}),
      u{k} as (select *, vary[1 + cast(floor({hex_share(text, 1, 8)} * len(vary)) as int)] as feature, {hex_share(text, 9, 12)} as place
        from v{k} where cnt > 1 and len(vary) > 0),
      sp{k} as (select tree, node, feature, case when lo[feature] + place * (hi[feature] - lo[feature]) >= hi[feature] then lo[feature]
        else lo[feature] + place * (hi[feature] - lo[feature]) end as cut from u{k}),
      leaf{k} as (select tree, node, {k} + {path_length('cnt')} as depth from v{k} where not (cnt > 1 and len(vary) > 0)),
      s{k + 1} as (select s.tree, s.xs, 2 * s.node + 1 + cast(s.xs[feature] > cut as int) as node from s{k} s join sp{k} p on p.tree = s.tree and p.node = s.node)"""
        )
    parts.append(f"w0 as (select {key} as id, {xs} as xs, tree, 0 as node from f, rounds, range(0, cast(rounds as bigint)) t(tree))")
    parts += [
        f"w{k + 1} as (select w.id, w.xs, w.tree, 2 * w.node + 1 + cast(w.xs[feature] > cut as int) as node from w{k} w join sp{k} p on p.tree = w.tree and p.node = w.node)"
        for k in range(height)
    ]
    walks = " union all ".join(f"select id, depth from w{k} w join leaf{k} l on l.tree = w.tree and l.node = w.node" for k in range(height + 1))
    score = significant(f"power(2, -sum(depth) / (max(rounds) * ({path_length(str(float(size)))})))")
    parts.append(f"paths as ({walks})")
    parts.append(f"s as (select id as {key}, {score} as score from paths, rounds group by id)")
    return key, ",\n      ".join(parts)


def isoforest(name: str, level: str | None = None) -> str:
    key, ctes = forest(name, "greatest(50, least(200, n // 10))")
    return f"{ctes} {flag_tail(key, level=level)}"


def contamination(name: str) -> str:
    _, ctes = forest(name, "100")
    return f"{ctes} select avg(cast(score > 0.5 as int)) as contamination from s"


def inne_default(name: str) -> str:
    """Rounds of 256 rows, each in the features whose hashes come first."""
    key, cols, base = scaled_source(name)
    d, size = len(cols), max(1, int(len(cols) ** 0.5))
    orders = f"list_sort(list_transform(range(0, {d}), lambda j: md5('0:' || round || ':' || j) || j))[1:{size}]"
    dist = " + ".join(f"case when list_contains(chosen, {j}) then (f.{x} - t.{x}) * (f.{x} - t.{x}) else 0 end" for j, x in enumerate(cols))
    return f"""with {base}, {hashed_rounds(key, 256, "greatest(50, least(200, cast(floor(log2(n) * 10) as bigint)))")},
      t as (select *, list_transform({orders}, lambda h: cast(substr(h, 33) as int)) as chosen from sampled),
      k as (select greatest(1, least(10, cast(floor(ln(n)) as int))) as k from c),
      m as (select t.round, f.{key} as id, list_avg(min(sqrt({dist}), (select k from k))) as m from f, t group by t.round, f.{key}),
      s as (select id as {key}, {significant('avg(m)')} as score from m group by id) {flag_tail(key)}"""


def mean_distance(name: str) -> str:
    key, cols, base = source(name)
    dist = " + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in cols)
    return f"with {base}, s as (select a.{key}, {significant(f'avg(sqrt({dist}))')} as score from f a, f b group by a.{key}) {flag_tail(key)}"


ELLIPTIC_SUPPORT = "greatest(0.5, least(0.9, (n - 3.0) / n))"
MCD_SUPPORT = "greatest(0.5, least(0.9, greatest(3, floor(n * 0.5)) / n))"


def _fit_2d(at: str, rows: str, x: str, y: str, by: str = "") -> str:
    group, key = (f" group by {by}", f"{by}, ") if by else ("", "")
    return (
        f"{at} as (select {key}avg({x}) as mx, avg({y}) as my, covar_pop({x}, {x}) as a, covar_pop({x}, {y}) as b, "
        f"covar_pop({y}, {y}) as d from {rows}{group})"
    )


def _dist_2d(at: str, model: str, x: str, y: str, by: str = "") -> str:
    key = f"{by}, " if by else ""
    return (
        f"{at} as (select {key}f.*, (d * ({x} - mx) * ({x} - mx) - 2 * b * ({x} - mx) * ({y} - my) "
        f"+ a * ({y} - my) * ({y} - my)) / (a * d - b * b) as dist from f, {model})"
    )


def _reweighted_2d(raw: str, key: str, x: str, y: str) -> list[str]:
    """Correction and reweighting from the model `raw`. For two features a chi-squared quantile
    at p is -2 ln(1 - p)."""
    return [
        _dist_2d("raw", raw, x, y),
        "corr as (select median(dist) / (-2 * ln(0.5)) as q from raw)",
        _fit_2d("last", "(select raw.* from raw, corr where dist / q < -2 * ln(0.025))", x, y),
        _dist_2d("fin", "last", x, y),
        f"s as (select {key}, {significant('dist')} as score from fin)",
    ]


def robust_2d(name: str, support: str, steps: int) -> str:
    """Concentration steps from the classical estimate, correction, reweighting."""
    key, (x, y), base = source(name)
    parts = [f"h as (select cast(floor({support} * n) as bigint) as h from c)", _fit_2d("m0", "f", x, y)]
    for i in range(steps):
        parts.append(_dist_2d(f"d{i}", f"m{i}", x, y))
        parts.append(
            f"k{i} as (select * from d{i} where dist <= (select max(dist) from "
            f"(select dist, row_number() over (order by dist) as r from d{i}), h where r <= h))"
        )
        parts.append(_fit_2d(f"m{i + 1}", f"k{i}", x, y))
    parts += _reweighted_2d(f"m{steps}", key, x, y)
    return f"with {base}, {', '.join(parts)} {flag_tail(key)}"


def robust_starts_2d(name: str, support: str, level: str | None = None, starts: int = 64, steps: int = 40) -> str:
    """Starts drawn by hash (three rows; of each fourth as many as support the estimate), each taking
    more concentration steps than it needs; the one of least determinant, corrected and
    reweighted. For tables that starts see whole."""
    key, (x, y), base = source(name)
    parts = [
        f"h as (select cast(floor({support} * n) as bigint) as h from c)",
        f"""k0 as (select start, {x}, {y} from (select start, f.*, row_number() over (partition by start
          order by md5('0:' || start || ':' || {key}), cast({key} as varchar)) as r from f, range(0, {starts}) t(start)), h
          where r <= case when start % 4 = 3 then h else 3 end)""",
        _fit_2d("m0", "k0", x, y, "start"),
    ]
    for i in range(steps):
        parts.append(_dist_2d(f"d{i}", f"m{i}", x, y, "start"))
        parts.append(
            f"k{i + 1} as (select start, {x}, {y} from (select *, row_number() over (partition by start order by dist) as r from d{i}), h where r <= h)"
        )
        parts.append(_fit_2d(f"m{i + 1}", f"k{i + 1}", x, y, "start"))
    parts.append(f"best as (select * exclude (start) from m{steps} order by ln(a * d - b * b), start limit 1)")
    parts += _reweighted_2d("best", key, x, y)
    return f"with {base}, {', '.join(parts)} {flag_tail(key, level=level)}"


def events_pipeline() -> str:
    """Estimated contamination, five detectors at that share, rows with three votes or more."""
    level = "(select (1 - contamination) * 100 / 100 from con)"
    detectors = [statistical("events2", c, level) for c in (zscore_ctes, hbos_ctes, ecod_ctes)]
    detectors += [isoforest("events2", level), robust_starts_2d("events2", MCD_SUPPORT, level)]
    flags = " union all ".join(f"select event_id, is_outlier from ({sql})" for sql in detectors)
    return f"""with con as materialized ({contamination("events2")}), flags as ({flags}),
      votes as (select event_id as row_id, count(*) as n_votes from flags where is_outlier group by event_id)
      select row_id, n_votes, cast(round_even(n_votes * 100.0 / 5.0, 0) as bigint) as consensus_pct,
        case when n_votes / 5.0 >= 0.8 then 'Very High' when n_votes / 5.0 >= 0.6 then 'High' else 'Moderate' end as confidence
      from votes where n_votes >= 3"""


# ---- votes -----------------------------------------------------------------------

VOTER_CTES = {"zscore": zscore_ctes, "hbos": hbos_ctes, "copod": copod_ctes, "ecod": ecod_ctes}


def flag_ctes(name: str, voters: list[str]) -> str:
    """CTEs down to `flags` (row_id, detector, score, is_outlier) and `votes`."""
    key, cols, base = source(name)
    chains, unions = [], []
    for voter in voters:
        chain, scored = VOTER_CTES[voter](name, f"{voter}_")
        chains.append(chain)
        unions.append(
            f"select {key} as row_id, '{voter}' as detector, score, "
            f"score > (select quantile_cont(score, 0.95) from {scored}) as is_outlier from {scored}"
        )
    return (
        f"with {base}, {', '.join(chains)}, flags as ({' union all '.join(unions)}), "
        "votes as (select row_id, count(*) as n_votes from flags where is_outlier group by row_id)"
    )


FLAGS = flag_ctes("profile", VOTERS)
TIER = (
    "cast(round_even(n_votes * 100.0 / 4.0, 0) as bigint) as consensus_pct, case when n_votes / 4.0 >= 0.8 then 'Very High' "
    "when n_votes / 4.0 >= 0.6 then 'High' else 'Moderate' end as confidence"
)
KEPT = "kept as (select * from f where o_custkey not in (select row_id from votes where n_votes >= 2))"


def event_components() -> str:
    """CTE `pc`: mean, leading axis (ux, uy) and both variances of (value, hour_of_day)."""
    _, (x, y), base = source("events2")
    return f"""with {base},
      cv as (select avg({x}) as mx, avg({y}) as my, covar_pop({x}, {x}) as a, covar_pop({x}, {y}) as b,
                    covar_pop({y}, {y}) as d from f),
      ev as (select *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) as l1,
                    (a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * b) as l2 from cv),
      un as (select *, b / sqrt(b * b + (l1 - a) * (l1 - a)) as ax, (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) as ay from ev),
      pc as (select *, case when abs(ax) >= abs(ay) then sign(ax) else sign(ay) end * ax as ux,
                    case when abs(ax) >= abs(ay) then sign(ax) else sign(ay) end * ay as uy from un)"""


def event_hull() -> str:
    """Per hour only the extreme values can be hull vertices, so edges are tried between
    those: an edge has every candidate on its left or on itself."""
    _, _, base = source("events2")
    return f"""with {base},
      p as (select distinct x, y from (select min(value) as x, hour_of_day as y from f group by hour_of_day
            union all select max(value), hour_of_day from f group by hour_of_day)),
      e as (select a.x as ax, a.y as ay, b.x as qx, b.y as qy from p a join p b on (a.x, a.y) <> (b.x, b.y)
            where not exists (select 1 from p c where
              (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
              or ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0
                  and ((c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y)) > 0))),
      v as (select ax as x, ay as y from e union select qx, qy from e),
      m as (select avg(x) as mx, avg(y) as my, count(*) as n from v),
      r as (select x, y, n, row_number() over (order by atan2(y - my, x - mx)) - 1 as r,
                   row_number() over (order by x, y) as place from v, m)
      select cast((r - (select r from r where place = 1) + n) % n as int) as position, x, y from r"""


def oracle_sql() -> dict[str, str]:
    lines = source("lines")[2]
    hex_source = source("events2")[2]
    ranks = " union all ".join(
        f"select {i} as f, {x} as v, count(*) as cnt from lineitem group by {x}" for i, x in enumerate(MEASURES)
    )
    profile_rows = " union all ".join(
        f"select '{x}' as feature, count(*) as n, round(avg({x}), 6) as mean, round(stddev_pop({x}), 6) as std, "
        f"round(min({x}), 6) as min, round(max({x}), 6) as max from lineitem"
        for x in MEASURES
    )
    bins = " union all ".join(
        f"select {i} as f, cast(own as int) as bin, count(*) as cnt from f join x_v{i} on {x} = v group by own"
        for i, x in enumerate(["value", "hour_of_day"])
    )
    scaled_cols = ", ".join(f"round({x}, 6) as {x}" for x in PROFILE_COLS)
    zs = statistical("profile", zscore_ctes)
    zs_events = statistical("events2", zscore_ctes)
    return {
        "clean_finite": """select cast(l_orderkey as double) as l_orderkey, l_extendedprice as price, l_tax as tax,
            cast(l_linenumber as double) as line from lineitem where l_discount <> 0 and l_tax <> 0 and l_linenumber <> 7""",
        "numeric_projection": "select cast(p_partkey as double) as p_partkey, cast(p_size as double) as p_size, p_retailprice from part",
        "column_subset": "select s_suppkey, s_acctbal from supplier",
        "standardize": f"with {scaled_source('profile')[2]} select o_custkey, {scaled_cols} from f",
        "feature_profile": profile_rows,
        "row_positions": "select row_number() over () - 1 as row_id, n_nationkey from nation",
        "csv_scan": """select cast(p_partkey as double) as p_partkey, p_name,
            case when p_size % 10 = 3 then null else cast(p_size as double) end as p_size, p_retailprice from part""",
        "percentile_prices": " union all ".join(
            f"select cast({q} as double) as fraction, round(quantile_cont(l_extendedprice, {q}), 6) as value from lineitem"
            for q in (0.5, 0.8, 0.85, 0.9, 0.95, 0.98)
        ),
        "histogram_events": f"with {hex_source}, {hbos_ctes('events2', 'x_')[0]} {bins}",
        "ranks_lineitem": f"""with vc as ({ranks}), n as (select count(*) as n from lineitem),
            cu as (select *, sum(cnt) over (partition by f order by v) as cum from vc)
            select f, v, cnt, cast(cum - (cnt - 1) / 2.0 as double) as avg_rank, round(cum / n, 9) as ecdf from cu, n""",
        "neighbours_customers": neighbours("profile", 10),
        "zscore_lineitem": statistical("lines", zscore_ctes),
        "zscore_events": zs_events,
        "zscore_customers": zs,
        "max_abs_z_fallback": statistical("accounts", zscore_ctes, guarded=False),
        "hbos_events": statistical("events2", hbos_ctes),
        "hbos_customers": statistical("profile", hbos_ctes),
        "hbos_lineitem": statistical("lines", hbos_ctes),
        "hbos_own_bin": statistical("events1", hbos_ctes, own_bin=True),
        "copod_customers": statistical("profile", copod_ctes),
        "copod_lineitem": statistical("lines", copod_ctes),
        "ecod_customers": statistical("profile", ecod_ctes),
        "ecod_lineitem": statistical("lines", ecod_ctes),
        "knn_customers": knn("profile"),
        "knn_parts": knn("parts"),
        "knn_parts_partitioned": knn("parts"),
        "knn_embeddings": knn("emb8"),
        "knn_embeddings_whole": knn("emb64"),
        "lof_customers": lof("profile"),
        "lof_documents": lof("docs"),
        "dbscan_customers": dbscan("profile"),
        "dbscan_documents": dbscan("docs"),
        "dbscan_parts": dbscan("parts"),
        "zscore_named_parts": by_name(statistical("parts", zscore_ctes)),
        "knn_named_parts": by_name(knn("parts")),
        "lof_named_parts": by_name(lof("parts")),
        "dbscan_named_parts": by_name(dbscan("parts")),
        "inne_customers_t5": inne("profile"),
        "inne_customers": inne_default("profile"),
        "isoforest_events": isoforest("events2"),
        "isoforest_customers": isoforest("profile"),
        "contamination_estimate": contamination("events2"),
        "mean_distance_fallback": mean_distance("accounts"),
        "mean_distance_orders": f"select o_orderkey, is_outlier from ({mean_distance('orders2')})",
        "elliptic_2d": robust_2d("events2", ELLIPTIC_SUPPORT, 3),
        "elliptic_events": robust_starts_2d("events2", ELLIPTIC_SUPPORT),
        "pipeline_events": events_pipeline(),
        "mcd_2d": robust_2d("events2", MCD_SUPPORT, 3),
        "flags": f"{FLAGS} select row_id, detector, {shown('score')} as score, is_outlier from flags",
        "wide_flags": f"{FLAGS} select row_id, "
        + ", ".join(f"bool_or(is_outlier) filter (where detector = '{v}') as {v}" for v in VOTERS)
        + " from flags group by row_id",
        "votes": f"{FLAGS} select * from votes",
        "consensus": f"{FLAGS} select * from votes where n_votes >= 2",
        "consensus_mask": f"{FLAGS} select o_custkey as row_id, coalesce(n_votes, 0) >= 2 as is_consensus from f left join votes on row_id = o_custkey",
        "remove_outliers": f"{FLAGS}, {KEPT} select * from kept",
        "votes_after_removal": f"""{FLAGS}, {KEPT} select row_id, count(*) as n_votes from flags
            where is_outlier and row_id in (select o_custkey from kept) group by row_id""",
        "confidence_tier": f"{FLAGS} select row_id, n_votes, {TIER} from votes where n_votes >= 2",
        "agreement_distribution": f"""{FLAGS} select n_votes, count(*) as n_rows,
            cast(round_even(n_votes * 100.0 / 4.0, 0) as bigint) as agreement_pct from votes where n_votes >= 2 group by n_votes""",
        "threshold_sweep": f"""{FLAGS} select cast(t as int) as threshold, (select count(*) from votes where n_votes >= t) as n_rows
            from range(1, 5) r(t)""",
        "max_agreement": f"""{FLAGS} select max(n_votes) as max_agreement,
            count(*) filter (where n_votes = (select max(n_votes) from votes)) as n_rows from votes""",
        "top_consensus": f"""{FLAGS}, k as (select count(*) as n from votes where n_votes >= 2),
            o as (select *, row_number() over (order by n_votes desc, row_id) as r from votes where n_votes >= 2)
            select row_id, n_votes from o, k where r <= case when n <= 20 then n when n <= 100 then 10 else 5 end""",
        "best_without_consensus": f"""{FLAGS}, o as (select *, row_number() over (order by row_id) as r from votes
            where n_votes > 1 and n_votes = (select max(n_votes) from votes)) select row_id, n_votes from o where r <= 5""",
        "detector_stats": f"""{FLAGS}, k as (select detector, count(*) filter (where is_outlier) as k, count(*) as n from flags group by detector)
            select detector, k as n_outliers, n - k as n_inliers, round(k / n, 9) as actual_contamination,
              cast(0.05 as double) as expected_contamination, round(k / n - cast(0.05 as double), 9) as contamination_difference,
              round(k / n * 100, 2) as detection_rate_pct from k""",
        "total_outliers": f"{FLAGS} select count(*) filter (where is_outlier) as total_outliers from flags",
        "precision_vs_labels": f"""{flag_ctes('docs', ['zscore', 'ecod'])}
            select count(*) as flagged, count(*) filter (where toxic = 1) as hits,
              round(count(*) filter (where toxic = 1) / count(*), 9) as precision
            from votes left join labels on doc_id = row_id""",
        "report_consensus": f"{FLAGS} select row_id, n_votes, {TIER} from votes where n_votes >= 2",
        "run_metadata": f"""with {source('profile')[2]} select n as n_rows, 4 as n_features, cast(0.05 as double) as contamination_used,
            'zscore,hbos,copod,ecod' as algorithms_requested, 'zscore,hbos,copod,ecod' as algorithms_successful,
            '' as algorithms_failed, cast(1 as double) as success_rate from c""",
        "pca_projection": f"""{event_components()} select event_id,
            round((value - mx) * ux + (hour_of_day - my) * uy, 6) as pc1,
            round(case when abs(uy) >= abs(ux) then sign(uy) else -sign(ux) end * ((value - mx) * uy - (hour_of_day - my) * ux), 6) as pc2
            from f, pc""",
        "projection_table_events": f"""select p.*, z.is_outlier from ({event_components()} select event_id,
            round((value - mx) * ux + (hour_of_day - my) * uy, 6) as pc1,
            round(case when abs(uy) >= abs(ux) then sign(uy) else -sign(ux) end * ((value - mx) * uy - (hour_of_day - my) * ux), 6) as pc2
            from f, pc) p join ({zs_events}) z using (event_id)""",
        "explained_variance": f"""{event_components()} select cast(1 as int) as component, round(l1 / (l1 + l2), 9) as ratio from pc
            union all select 2, round(l2 / (l1 + l2), 9) from pc union all select 0, cast(1 as double) from pc""",
        "picture_stats": f"""select round(avg(cast(is_outlier as int)) * 100, 6) as outlier_rate_pct,
            cast(100 as double) as variance_explained_pct from ({zs_events})""",
        "picture_summary": f"{FLAGS} select detector, count(*) filter (where is_outlier) as n_outliers from flags group by detector",
        "outlier_preserving_sample": f"""with z as ({zs}), k as (select count(*) as n, count(*) filter (where is_outlier) as k from z),
            o as (select *, row_number() over (order by md5(cast(o_custkey as varchar) || ':0'), o_custkey) as r from z where not is_outlier)
            select o_custkey, is_outlier from z where is_outlier
            union all select o_custkey, is_outlier from o, k where r <= greatest(0, least(n // 2 - k, n - k))""",
        "convex_hull": event_hull(),
        "hex_density": f"""with {hex_source},
            g as (select min(value) as a, max(value) as b, min(hour_of_day) as p, max(hour_of_day) as q from f),
            w as (select a - 1e-9 * (b - a) as x0, b + 1e-9 * (b - a) as x1, p - 1e-9 * (q - p) as y0, q + 1e-9 * (q - p) as y1 from g),
            z as (select *, (x1 - x0) / 30 as sx, (y1 - y0) / 17 as sy from w),
            t as (select z.*, (value - x0) / sx as u, (hour_of_day - y0) / sy as v from f, z),
            l as (select *, floor(u + 0.5) as i1, floor(v + 0.5) as j1, floor(u) as i2, floor(v) as j2 from t),
            e as (select *, (u - i1) * (u - i1) + 3.0 * (v - j1) * (v - j1)
                    < (u - (i2 + 0.5)) * (u - (i2 + 0.5)) + 3.0 * (v - (j2 + 0.5)) * (v - (j2 + 0.5)) as one from l)
            select case when one then 1 else 2 end as lattice, cast(case when one then i1 else i2 end as bigint) as ix,
              cast(case when one then j1 else j2 end as bigint) as iy,
              round(any_value((case when one then i1 else i2 + 0.5 end) * sx + x0), 6) as x,
              round(any_value((case when one then j1 else j2 + 0.5 end) * sy + y0), 6) as y, count(*) as n
            from e group by 1, 2, 3""",
    }
