"""SQL for DuckDB that states the results of the registered queries.

DuckDB's UHUGEINT has room for products of 64-bit values; each step is brought back below 2^64.
"""

from __future__ import annotations

from keyloom.functions.u64 import GAMMA, MIX_1, MIX_2
from keyloom.sources.generator import RelationSpec, draws_of_skewed, hot_partitions

_TWO64 = "18446744073709551616::UHUGEINT"


def _steps(name: str, source: str, columns: list[str], keep: str) -> str:
    """CTEs that run the splitmix64 finaliser over UHUGEINT columns of `source`."""
    out, before = [], source
    for i, (shift, factor) in enumerate(((30, MIX_1), (27, MIX_2), (31, None))):
        cells = []
        for c in columns:
            x = f"xor({c}, {c} >> {shift})"
            cells.append(f"({x} * {factor}::UHUGEINT) % {_TWO64} AS {c}" if factor else f"{x} AS {c}")
        after = f"{name}{i}"
        out.append(f"{after} AS (SELECT {keep}, {', '.join(cells)} FROM {before})")
        before = after
    return ", ".join(out)



def _digest(pairs: str, group: str = "") -> str:
    """A digest of `pairs`, a query of (key UHUGEINT, m) and the group's column."""
    keep = "m, key" + (f", {group}" if group else "")
    start = f"SELECT {keep}, (key + {GAMMA}::UHUGEINT) % {_TWO64} AS h1, (xor(key, {GAMMA}::UHUGEINT) + {GAMMA}::UHUGEINT) % {_TWO64} AS h2 FROM pairs"

    def total(x: str) -> str:
        return f"CAST(coalesce(sum(CAST(({x}) % {_TWO64} AS HUGEINT)), 0) % 18446744073709551616::HUGEINT AS VARCHAR)"

    select = f"SELECT {group + ', ' if group else ''}{total('m::UHUGEINT')} AS join_count, {total('h1 * m')} AS checksum1, {total('h2 * m')} AS checksum2 FROM s2"
    return f"WITH pairs AS ({pairs}), h AS ({start}), {_steps('s', 'h', ['h1', 'h2'], keep)} {select}{' GROUP BY ' + group if group else ''}"


def _pairs(r: str, r_key: str, s: str, s_key: str, more: str = "") -> str:
    return (
        f"SELECT a.k::UHUGEINT AS key, (a.n * b.n)::UHUGEINT AS m{more} FROM (SELECT {r_key}::BIGINT AS k, count(*) AS n FROM {r} GROUP BY 1) a "
        f"JOIN (SELECT {s_key}::BIGINT AS k, count(*) AS n FROM {s} GROUP BY 1) b USING (k)"
    )


def _pid(key: str, p: int) -> str:
    return f"(xor({key}, {key} >> 32) & {p - 1})::INT"


def _histogram(table: str, key: str, p: int) -> str:
    return f"SELECT p.pid::INT AS pid, coalesce(c.n, 0)::BIGINT AS n FROM range({p}) p(pid) LEFT JOIN (SELECT {_pid(key, p)} AS pid, count(*) AS n FROM {table} GROUP BY 1) c ON c.pid = p.pid"


def _chunks(chunk: str, chunks: int, p: int) -> str:
    return (
        f"SELECT c.chunk::INT AS chunk, p.pid::INT AS pid, coalesce(x.n, 0)::BIGINT AS n FROM range({chunks}) c(chunk) CROSS JOIN range({p}) p(pid) "
        f"LEFT JOIN (SELECT ({chunk})::INT AS chunk, {_pid('o_custkey', p)} AS pid, count(*) AS n FROM orders, (SELECT count(*) AS total FROM orders) GROUP BY 1, 2) x ON x.chunk = c.chunk AND x.pid = p.pid"
    )


_CEIL_CHUNK = "o_orderkey // ((total + 7) // 8)"
_EVEN_CHUNK = "CASE WHEN o_orderkey < (total % 7) * (total // 7 + 1) THEN o_orderkey // (total // 7 + 1) ELSE total % 7 + (o_orderkey - (total % 7) * (total // 7 + 1)) // (total // 7) END"


def _uniform(spec: RelationSpec) -> str:
    """(row_idx, key) of a uniform relation."""
    start = f"SELECT range AS row_idx, ({spec.seed}::UHUGEINT + (2 * range + 2)::UHUGEINT * {GAMMA}::UHUGEINT) % {_TWO64} AS d FROM range({spec.n})"
    return f"WITH g AS ({start}), {_steps('t', 'g', ['d'], 'row_idx')} SELECT row_idx, (d % {spec.max_key})::BIGINT AS key FROM t2"


def _skewed(spec: RelationSpec) -> str:
    """(row_idx, key) of a skewed relation; the hot partitions are literals.

    Where record i begins is found by doubling: k(b) leads from a draw to where 2^b records later begin, and the bits
    of i say which of them to follow.
    """
    hot, bits = hot_partitions(spec), max(1, (spec.n - 1).bit_length())
    out = [f"g AS (SELECT range AS j, ({spec.seed}::UHUGEINT + (range + 1)::UHUGEINT * {GAMMA}::UHUGEINT) % {_TWO64} AS d FROM range({4 * spec.n + 8}))", _steps("t", "g", ["d"], "j")]
    out.append(f"w AS MATERIALIZED (SELECT j, d, d::UBIGINT::DOUBLE / 18446744073709551616::DOUBLE AS u, (d::UBIGINT::DOUBLE / 18446744073709551616::DOUBLE) < {spec.sigma}::DOUBLE AS skewed FROM t2)")
    out.append(f"k0 AS MATERIALIZED (SELECT j, j + CASE WHEN skewed THEN {draws_of_skewed(spec)} ELSE 2 END AS after FROM w)")
    out += [f"k{b} AS MATERIALIZED (SELECT x.j, y.after FROM k{b - 1} x JOIN k{b - 1} y ON x.after = y.j)" for b in range(1, bits)]
    out.append(f"p0 AS (SELECT range AS i, 0::BIGINT AS place FROM range({spec.n}))")
    out += [f"p{b + 1} AS MATERIALIZED (SELECT i, CASE WHEN (i >> {b}) & 1 = 1 THEN after ELSE place END AS place FROM p{b} LEFT JOIN k{b} ON place = j)" for b in range(bits)]
    cells = "a.skewed AS skewed, b.d AS d2, c.d AS d3, e.d AS d4, " + f"[{', '.join(map(str, hot))}][least(floor(pow(b.u, {spec.crest}::DOUBLE) * {len(hot)})::BIGINT, {len(hot) - 1}) + 1] AS target"
    out.append(f"r AS (SELECT i, {cells} FROM p{bits} JOIN w a ON a.j = place JOIN w b ON b.j = place + 1 JOIN w c ON c.j = place + 2 JOIN w e ON e.j = place + 3)")
    if spec.max_key < spec.p:
        key = f"target % {spec.max_key}"
    elif spec.max_key < 1 << 32:
        key = f"(d3 % {spec.max_key // spec.p})::BIGINT * {spec.p} + target"
    else:
        high, low = f"(d3 % {spec.max_key >> 32})::BIGINT", f"(d4 % {(1 << 32) // spec.p})::BIGINT * {spec.p}"
        key = f"({high} << 32) + {low} + xor(target, {high} % {spec.p})"
    return f"WITH {', '.join(out)} SELECT i AS row_idx, (CASE WHEN skewed THEN {key} ELSE (d2 % {spec.max_key})::BIGINT END)::BIGINT AS key FROM r"


def statements(uniform: RelationSpec, constant: RelationSpec, skewed: RelationSpec, wide_spec: RelationSpec, small: RelationSpec) -> dict[str, str]:
    orders = _digest(_pairs("lineitem", "l_orderkey", "orders", "o_orderkey"))
    part = _digest(_pairs("lineitem", "l_partkey", "part", "p_partkey"))
    nations = _digest(_pairs("supplier", "s_nationkey", "nation", "n_nationkey"))
    gamma = f"{GAMMA}::UHUGEINT"
    hashed = f"SELECT o_orderkey, (o_orderkey::UHUGEINT + {gamma}) % {_TWO64} AS h1, (xor(o_orderkey::UHUGEINT, {gamma}) + {gamma}) % {_TWO64} AS h2 FROM orders"
    wide = "(o_orderkey * 4294967311)"
    line = f"SELECT (l_orderkey::UHUGEINT + {gamma}) % {_TWO64} AS h FROM lineitem"
    return {
        "join_digest": orders,
        "join_digest_merge": orders,
        "join_digest_hash": orders,
        "join_digest_merged": orders,
        "join_digest_fk_part": part,
        "join_digest_broadcast": part,
        "join_digest_many_to_many": _digest(_pairs("lineitem", "l_suppkey", "customer", "c_nationkey")),
        "join_digest_events": _digest(_pairs("events", "user_id", "customer", "c_custkey")),
        "join_digest_by_partition": _digest(_pairs("lineitem", "l_orderkey", "orders", "o_orderkey", f", {_pid('a.k', 16)} AS pid"), "pid"),
        "join_digest_empty": _digest(_pairs("(SELECT * FROM orders WHERE o_orderkey < 100)", "o_orderkey", "(SELECT * FROM orders WHERE o_orderkey >= 100)", "o_orderkey")),
        "join_verify_bruteforce": nations,
        "join_self_check": "SELECT true AS equal",
        "relation_digest": f"WITH g AS ({line}), {_steps('t', 'g', ['h'], '1 AS one')} SELECT count(*) AS n, CAST(sum(CAST(h AS HUGEINT)) % 18446744073709551616::HUGEINT AS VARCHAR) AS digest FROM t2",
        "splitmix64_keys": f"WITH g AS ({hashed}), {_steps('t', 'g', ['h1', 'h2'], 'o_orderkey')} SELECT o_orderkey, CAST(h1 AS VARCHAR) AS hash, CAST(h2 AS VARCHAR) AS hash2 FROM t2",
        "partition_id": f"SELECT o_orderkey, {_pid('o_orderkey', 16)} AS pid, {_pid(wide, 1024)} AS pid_wide FROM orders",
        "partition_histogram": _histogram("lineitem", "l_partkey", 64),
        "partition_offsets": f"SELECT pid, n, (sum(n) OVER (ORDER BY pid) - n)::BIGINT AS begin_at, (sum(n) OVER (ORDER BY pid))::BIGINT AS end_at FROM ({_histogram('lineitem', 'l_partkey', 64)})",
        "chunk_histogram_matrix": _chunks(_CEIL_CHUNK, 8, 16),
        "chunk_histogram_matrix_even": _chunks(_EVEN_CHUNK, 7, 16),
        "chunk_offsets_matrix": f"SELECT chunk, pid, n, (sum(n) OVER (ORDER BY pid, chunk) - n)::BIGINT AS offset_at FROM ({_chunks(_CEIL_CHUNK, 8, 16)})",
        "partition_layout": f"SELECT o_orderkey, o_custkey, o_orderkey AS row_idx, {_pid('o_custkey', 16)} AS pid, row_number() OVER (ORDER BY {_pid('o_custkey', 16)}, o_orderkey) - 1 AS position FROM orders",
        "partition_load_report": f"SELECT pid AS id, n AS records, round(n * 100.0::DOUBLE / sum(n) OVER (), 2) AS percent FROM ({_histogram('events', 'user_id', 64)})",
        "key_frequency": "SELECT l_suppkey AS key, count(*) AS n FROM lineitem GROUP BY 1",
        "generate_uniform": _uniform(uniform),
        "generate_constant": f"SELECT range AS row_idx, 0::BIGINT AS key FROM range({constant.n})",
        "generate_skewed": _skewed(skewed),
        "generate_skewed_wide": _skewed(wide_spec),
        "generate_skewed_small": _skewed(small),
        "generated_load": f"SELECT pid AS id, n AS records, round(n * 100.0::DOUBLE / sum(n) OVER (), 2) AS percent FROM ({_histogram('(' + _skewed(skewed) + ')', 'key', skewed.p)})",
        "synthetic_join_digest_skewed": _digest(_pairs(f"({_skewed(skewed)})", "key", f"({_skewed(skewed.other())})", "key")),
        "synthetic_join_digest_uniform": _digest(_pairs(f"({_uniform(uniform)})", "key", f"({_uniform(uniform.other())})", "key")),
        "sample_stats": "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS median, round(stddev_pop(l_quantity), 6) AS std FROM lineitem GROUP BY 1",
        "critical_path": "SELECT phase, max(s) AS seconds FROM (SELECT l_suppkey, l_returnflag AS phase, sum(l_quantity) AS s FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    }
