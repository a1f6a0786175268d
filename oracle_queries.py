"""The suite's queries in SQL, as DuckDB runs them on the same tables.

The catalog leads from region over nation, supplier, part and order to customer, so
anything that follows the layers is written out type by type here.
"""

from __future__ import annotations

NODES = """
nodes AS (
  SELECT 'region_' || r_regionkey AS node_id, 'tool' AS node_type, r_name AS name FROM region
  UNION ALL SELECT 'nation_' || n_nationkey, 'tool', n_name FROM nation
  UNION ALL SELECT 'supplier_' || s_suppkey, 'dataset', s_name FROM supplier
  UNION ALL SELECT 'part_' || p_partkey, 'model', p_name FROM part
  UNION ALL SELECT 'order_' || o_orderkey, 'product', o_orderpriority FROM orders
  UNION ALL SELECT 'customer_' || c_custkey, 'product', c_name FROM customer)"""

EDGES = """
raw_edges AS (
  SELECT 'region_' || n_regionkey AS src, 'nation_' || n_nationkey AS dst, 0.9::DOUBLE AS weight FROM nation
  UNION ALL SELECT 'nation_' || s_nationkey, 'supplier_' || s_suppkey, 0.5::DOUBLE FROM supplier
  UNION ALL SELECT 'supplier_' || l_suppkey, 'part_' || l_partkey, max(l_discount) FROM lineitem GROUP BY l_suppkey, l_partkey
  UNION ALL SELECT 'part_' || l_partkey, 'order_' || l_orderkey, max(l_quantity) / 50 FROM lineitem GROUP BY l_partkey, l_orderkey
  UNION ALL SELECT 'order_' || o_orderkey, 'customer_' || o_custkey, 0.9::DOUBLE FROM orders),
edges AS (SELECT src, dst, greatest(0.0, least(1.0, weight)) AS weight FROM raw_edges)"""

SEEDS = "seeds AS (SELECT 'supplier_' || s_suppkey AS node_id, 1.0::DOUBLE AS p FROM supplier WHERE s_acctbal < 0)"

CATALOG = f"{NODES},\n{EDGES},\n{SEEDS}"

TYPES = ("region", "nation", "supplier", "part", "order", "customer")


def is_kind(column: str, kind: str) -> str:
    return f"starts_with({column}, '{kind}_')"


def hash_chain(name: str, extra: str = "''") -> str:
    """CTE ``name`` (node_id, hash); ``extra`` is content text after the name entry."""
    ctes = []
    for i, kind in enumerate(TYPES):
        own = f"'nodeId=' || n.node_id || ';nodeType=' || n.node_type || ';creator=unknown;name=' || n.name || ';' || {extra}"
        if i == 0:
            ctes.append(
                f"{name}_0 AS (SELECT n.node_id, sha256({own}) AS hash FROM nodes n WHERE {is_kind('n.node_id', kind)})"
            )
        else:
            ctes.append(
                f"{name}_{i}p AS (SELECT e.dst, string_agg('parent=' || h.hash || ';', '' ORDER BY h.hash) AS t "
                f"FROM edges e JOIN {name}_{i - 1} h ON h.node_id = e.src GROUP BY e.dst),\n"
                f"{name}_{i} AS (SELECT n.node_id, sha256({own} || coalesce(p.t, '')) AS hash "
                f"FROM nodes n LEFT JOIN {name}_{i}p p ON p.dst = n.node_id WHERE {is_kind('n.node_id', kind)})"
            )
    union = " UNION ALL ".join(f"SELECT * FROM {name}_{i}" for i in range(len(TYPES)))
    return ",\n".join(ctes) + f",\n{name} AS ({union})"


def risk_chain() -> str:
    """CTE ``scores`` (node_id, risk)."""
    ctes = ["risk_0 AS (SELECT node_id, 0.0::DOUBLE AS risk FROM nodes WHERE starts_with(node_id, 'region_'))"]
    for i, kind in enumerate(TYPES[1:], start=1):
        ctes.append(
            f"risk_{i}p AS (SELECT e.dst, 1.0 - product(1.0 - e.weight * r.risk) AS risk "
            f"FROM edges e JOIN risk_{i - 1} r ON r.node_id = e.src GROUP BY e.dst),\n"
            f"risk_{i} AS (SELECT n.node_id, greatest(coalesce(s.p, 0.0), coalesce(p.risk, 0.0)) AS risk "
            f"FROM nodes n LEFT JOIN risk_{i}p p ON p.dst = n.node_id LEFT JOIN seeds s ON s.node_id = n.node_id "
            f"WHERE {is_kind('n.node_id', kind)})"
        )
    union = " UNION ALL ".join(f"SELECT * FROM risk_{i}" for i in range(len(TYPES)))
    return ",\n".join(ctes) + f",\nscores AS ({union}),\neven AS (SELECT node_id, round(risk + 1e-9, 6) AS risk FROM scores)"


def level(risk: str) -> str:
    return (
        f"CASE WHEN {risk} >= 0.75 THEN 'CRITICAL' WHEN {risk} >= 0.5 THEN 'HIGH' WHEN {risk} >= 0.25 THEN 'MEDIUM' "
        f"WHEN {risk} > 0 THEN 'LOW' ELSE 'SAFE' END"
    )


def rank(kind: str) -> str:
    return f"CASE {kind} WHEN 'product' THEN 0 WHEN 'model' THEN 1 WHEN 'tool' THEN 2 WHEN 'dataset' THEN 3 ELSE 9 END"


def walk(name: str, starts: str, near: str, far: str, rounds: int) -> str:
    """CTE ``name`` (query_id, node_id, hops) with least hops, starts left out."""
    ctes = [f"{name}_0 AS (SELECT DISTINCT node_id AS query_id, node_id FROM ({starts}))"]
    for i in range(1, rounds + 1):
        ctes.append(
            f"{name}_{i} AS (SELECT DISTINCT f.query_id, e.{far} AS node_id "
            f"FROM {name}_{i - 1} f JOIN edges e ON e.{near} = f.node_id)"
        )
    union = " UNION ALL ".join(f"SELECT query_id, node_id, {i} AS hops FROM {name}_{i}" for i in range(1, rounds + 1))
    return ",\n".join(ctes) + f",\n{name} AS (SELECT query_id, node_id, min(hops) AS hops FROM ({union}) GROUP BY ALL)"


FIRST_CUSTOMERS = "SELECT 'customer_' || min(c_custkey) AS node_id FROM customer GROUP BY c_nationkey"
ALL_CUSTOMERS = "SELECT 'customer_' || c_custkey AS node_id FROM customer"
ALL_SUPPLIERS = "SELECT 'supplier_' || s_suppkey AS node_id FROM supplier"
ALL_NATIONS = "SELECT 'nation_' || n_nationkey AS node_id FROM nation"
SEED_IDS = "SELECT node_id FROM seeds"
DEEPEST = len(TYPES) - 1
POISON = "CASE WHEN n.node_id IN (SELECT node_id FROM seeds) THEN 'poisoned=true;' ELSE '' END"

HOME_PAIRS = """pairs AS (
  SELECT DISTINCT 'nation_' || c_nationkey AS src, 'customer_' || c_custkey AS dst FROM customer
  UNION SELECT DISTINCT 'customer_' || c_custkey, 'nation_' || c_nationkey FROM customer)"""

LEVEL_CELLS = ", ".join(
    f"count(*) FILTER (WHERE {level('risk')} = '{n}') AS {n.lower()}" for n in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "SAFE")
)


def impact_rows(hops: str) -> str:
    return (
        f"SELECT w.query_id, w.node_id, n.node_type, r.risk, {level('r.risk')} AS risk_level, {hops} AS hops "
        "FROM w JOIN nodes n ON n.node_id = w.node_id JOIN even r ON r.node_id = w.node_id"
    )


def label_chain() -> str:
    """CTE ``labels`` (node_id, disc, fin) on the forest of least parents."""
    ctes = [
        "forest AS (SELECT n.node_id, p.parent FROM nodes n "
        "LEFT JOIN (SELECT dst, min(src) AS parent FROM edges GROUP BY dst) p ON p.dst = n.node_id)"
    ]
    for i in range(DEEPEST, -1, -1):
        below = "0" if i == DEEPEST else "coalesce(c.s, 0)"
        join = "" if i == DEEPEST else (
            f"LEFT JOIN (SELECT parent, sum(size) AS s FROM size_{i + 1} GROUP BY parent) c ON c.parent = f.node_id "
        )
        ctes.append(
            f"size_{i} AS (SELECT f.node_id, f.parent, (1 + {below})::BIGINT AS size FROM forest f {join}"
            f"WHERE {is_kind('f.node_id', TYPES[i])})"
        )
    union = " UNION ALL ".join(f"SELECT * FROM size_{i}" for i in range(len(TYPES)))
    ctes.append(f"sizes AS ({union})")
    ctes.append(
        "offsets AS (SELECT *, coalesce(sum(2 * size) OVER (PARTITION BY parent ORDER BY node_id "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM sizes)"
    )
    for i, kind in enumerate(TYPES):
        if i == 0:
            ctes.append(f"label_0 AS (SELECT node_id, 1 + off AS disc, size FROM offsets WHERE {is_kind('node_id', kind)})")
        else:
            ctes.append(
                f"label_{i} AS (SELECT o.node_id, 1 + o.off + coalesce(l.disc, 0) AS disc, o.size FROM offsets o "
                f"LEFT JOIN label_{i - 1} l ON l.node_id = o.parent WHERE {is_kind('o.node_id', kind)})"
            )
    union = " UNION ALL ".join(f"SELECT * FROM label_{i}" for i in range(len(TYPES)))
    ctes.append(f"labels AS (SELECT node_id, disc::BIGINT AS disc, (disc + 2 * size - 1)::BIGINT AS fin FROM ({union}))")
    return ",\n".join(ctes)


LISTS = """
places AS (SELECT dst AS node_id, src, (row_number() OVER (PARTITION BY dst ORDER BY src) - 1) // 10000 AS part FROM edges),
lists AS (SELECT node_id, part::BIGINT AS part, string_agg(src, '>' ORDER BY src) AS parents, count(*) AS n FROM places GROUP BY ALL)"""

LAYERS = """lens AS (
  SELECT node_id, 0 AS len FROM nodes WHERE node_id NOT IN (SELECT dst FROM edges)
  UNION SELECT e.dst, l.len + 1 FROM lens l JOIN edges e ON e.src = l.node_id),
layers AS (SELECT node_id, max(len)::BIGINT AS layer FROM lens GROUP BY node_id)"""

BLOCKS = """
edges AS (
  SELECT 'part_' || p.p_partkey AS src, 'part_' || q.p_partkey AS dst
  FROM part p CROSS JOIN (VALUES (1), (3), (7)) s(step) JOIN part q ON q.p_partkey = p.p_partkey + s.step
  WHERE p.p_partkey // 16 = q.p_partkey // 16),
nodes AS (SELECT 'part_' || p_partkey AS node_id FROM part)"""


FIRST_PAIRS = "SELECT 'nation_' || c_nationkey AS src, 'customer_' || min(c_custkey) AS dst FROM customer GROUP BY c_nationkey"
ALL_PAIRS = "SELECT 'nation_' || c_nationkey AS src, 'customer_' || c_custkey AS dst FROM customer"


def catalog_path_sql(pairs: str = FIRST_PAIRS) -> str:
    """Least path text per step count; a pair is answered by its smallest count."""
    ctes = [
        f"pairs AS ({pairs})",
        *[walk("up", "SELECT DISTINCT dst AS node_id FROM pairs", "dst", "src", DEEPEST).replace("\n", " ")],
        "step_0 AS (SELECT src, dst, src AS node_id, [src] AS path FROM pairs)",
    ]
    for i in range(1, DEEPEST + 1):
        ctes.append(
            f"step_{i} AS (SELECT s.src, s.dst, e.dst AS node_id, min(list_append(s.path, e.dst)) AS path "
            f"FROM step_{i - 1} s JOIN edges e ON e.src = s.node_id "
            "WHERE e.dst = s.dst OR EXISTS (SELECT 1 FROM up u WHERE u.query_id = s.dst AND u.node_id = e.dst) "
            "GROUP BY s.src, s.dst, e.dst)"
        )
    union = " UNION ALL ".join(f"SELECT *, {i} AS hops FROM step_{i} WHERE node_id = dst" for i in range(DEEPEST + 1))
    ctes.append(f"found AS (SELECT src, dst, arg_min(path, hops) AS path, min(hops) AS hops FROM ({union}) GROUP BY src, dst)")
    return (
        f"WITH {CATALOG},\n" + ",\n".join(ctes) + "\nSELECT p.src, p.dst, f.path IS NOT NULL AS reachable, "
        "coalesce(array_to_string(f.path, '>'), '') AS path, coalesce(f.hops, 0)::BIGINT AS hops "
        "FROM pairs p LEFT JOIN found f ON f.src = p.src AND f.dst = p.dst"
    )


def report_sql() -> str:
    def head(rows: str, order: str, limit: int) -> str:
        return (
            "(SELECT query_id, string_agg(node_id, '>' ORDER BY pos) AS ids FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS pos FROM {rows}) "
            f"WHERE pos <= {limit} GROUP BY query_id)"
        )

    facts = "JOIN nodes n ON n.node_id = w.node_id JOIN even r ON r.node_id = w.node_id"
    kinds = ", ".join(
        f"count(*) FILTER (WHERE node_type = '{k}') AS {k}s" for k in ("product", "model", "tool", "dataset")
    )
    shown = ", ".join(f"coalesce(c.{k}s, 0) AS {k}s" for k in ("product", "model", "tool", "dataset"))
    return (
        f"WITH {CATALOG},\n{risk_chain()},\n{hash_chain('h')},\n"
        f"{walk('d', SEED_IDS, 'src', 'dst', DEEPEST)},\n{walk('a', SEED_IDS, 'dst', 'src', DEEPEST)},\n"
        f"down AS (SELECT w.query_id, w.node_id, n.node_type, r.risk FROM d w {facts}),\n"
        f"up AS (SELECT w.query_id, w.node_id, n.node_type, r.risk FROM a w {facts}),\n"
        f"c AS (SELECT query_id, count(*) AS total, {kinds} FROM down GROUP BY query_id),\n"
        "u AS (SELECT query_id, count(*) AS total FROM up GROUP BY query_id)\n"
        f"SELECT s.node_id AS query_id, n.node_type, r.risk, h.hash, coalesce(c.total, 0) AS total_impacted, {shown}, "
        "coalesce(u.total, 0) AS upstream_lineage, coalesce(t.ids, '') AS impacted_nodes, coalesce(b.ids, '') AS ancestor_nodes "
        "FROM seeds s JOIN nodes n ON n.node_id = s.node_id JOIN even r ON r.node_id = s.node_id JOIN h ON h.node_id = s.node_id "
        "LEFT JOIN c ON c.query_id = s.node_id LEFT JOIN u ON u.query_id = s.node_id "
        f"LEFT JOIN {head('down', 'risk DESC, ' + rank('node_type') + ', node_id', 20)} t ON t.query_id = s.node_id "
        f"LEFT JOIN {head('up', 'risk DESC, node_id', 10)} b ON b.query_id = s.node_id"
    )


def diffusion_sql(rounds: int = 15) -> str:
    """Damped rounds from the bare seeds until the largest change is below 1e-6."""
    ctes = ["d0 AS (SELECT n.node_id, coalesce(s.p, 0.0) AS risk FROM nodes n LEFT JOIN seeds s ON s.node_id = n.node_id)"]
    for k in range(1, rounds + 1):
        ctes.append(
            f"p{k} AS MATERIALIZED (SELECT e.dst, 1.0 - product(1.0 - e.weight * d.risk) AS pushed "
            f"FROM edges e JOIN d{k - 1} d ON d.node_id = e.src GROUP BY e.dst),\n"
            f"d{k} AS MATERIALIZED (SELECT d.node_id, CASE WHEN p.pushed IS NULL THEN d.risk "
            f"ELSE greatest(d.risk, 0.85 * p.pushed + (1.0 - 0.85) * d.risk) END AS risk "
            f"FROM d{k - 1} d LEFT JOIN p{k} p ON p.dst = d.node_id),\n"
            f"c{k} AS (SELECT {k} AS round, max(abs(a.risk - b.risk)) AS change, sum(a.risk) AS total "
            f"FROM d{k} a JOIN d{k - 1} b ON a.node_id = b.node_id)"
        )
    union = " UNION ALL ".join(f"SELECT * FROM c{k}" for k in range(1, rounds + 1))
    return (
        f"WITH {CATALOG},\n" + ",\n".join(ctes) + f",\nall_rounds AS ({union}),\n"
        f"stop AS (SELECT least({rounds}, coalesce(min(round) FILTER (WHERE change < 1e-6), {rounds})) AS round FROM all_rounds)\n"
        "SELECT a.round::BIGINT AS rounds, a.change < 1e-6 AS converged, round(a.change, 6) AS change, "
        "round(a.total, 3) AS total_risk FROM all_rounds a JOIN stop ON a.round = stop.round"
    )


def diffusion_rows_sql(rounds: int = 15) -> str:
    """The scores in the round that :func:`diffusion_sql` stops at."""
    whole = diffusion_sql(rounds)
    union = " UNION ALL ".join(f"SELECT {k} AS round, * FROM d{k}" for k in range(1, rounds + 1))
    return (
        whole[: whole.rindex("SELECT a.round::BIGINT")]
        + f"SELECT d.node_id, round(d.risk + 1e-9, 6) AS risk FROM ({union}) d JOIN stop ON d.round = stop.round"
    )


def report_rows_sql() -> str:
    """The leading rows of both sides of every report, and the error of an unknown id."""
    whole = report_sql()
    kinds = rank("node_type")

    def side(rows: str, name: str, order: str, limit: int) -> str:
        return (
            f"SELECT query_id, NULL AS error, '{name}' AS side, pos - 1 AS place, node_id, node_type, risk, NULL::BIGINT AS hops FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS pos FROM {rows}) WHERE pos <= {limit}"
        )

    return (
        whole[: whole.rindex("SELECT s.node_id AS query_id")]
        + side("down", "down", f"risk DESC, {kinds}, node_id", 20)
        + " UNION ALL "
        + side("up", "up", "risk DESC, node_id", 10)
        + " UNION ALL SELECT 'nobody', 'Node not found: nobody', NULL, NULL, NULL, NULL, NULL, NULL"
    )


def cycle_sql(where: str = "") -> str:
    return f"""
        WITH {CATALOG},
        back AS (SELECT DISTINCT 'part_' || l_partkey AS p FROM lineitem WHERE l_returnflag = 'R'{where}),
        o AS (SELECT DISTINCT e.dst AS node_id FROM edges e JOIN back b ON b.p = e.src),
        c AS (SELECT DISTINCT e.dst AS node_id FROM edges e JOIN o ON o.node_id = e.src)
        SELECT p AS node_id FROM back UNION ALL SELECT node_id FROM o UNION ALL SELECT node_id FROM c"""


def proof_targets_sql(ids: str) -> str:
    return f"""
        WITH {CATALOG}, {hash_chain("h")}, {walk("w", ids, "dst", "src", DEEPEST)}, ids AS ({ids}),
        sizes AS (SELECT query_id, count(*) AS n FROM w GROUP BY query_id)
        SELECT i.node_id AS target, h.hash AS target_hash, 1 + coalesce(s.n, 0) AS chain_length
        FROM ids i JOIN h ON h.node_id = i.node_id LEFT JOIN sizes s ON s.query_id = i.node_id"""


def proof_rows_sql(ids: str) -> str:
    return f"""
        WITH {CATALOG}, {hash_chain("h")}, {walk("w", ids, "dst", "src", DEEPEST)},
        members AS (SELECT query_id, node_id FROM w UNION ALL SELECT node_id, node_id FROM ({ids}))
        , {LISTS}
        SELECT m.query_id AS proof_id, m.node_id, coalesce(l.part, 0) AS part, n.node_type,
               'nodeId=' || n.node_id || ';nodeType=' || n.node_type || ';creator=unknown;name=' || n.name || ';' AS own,
               h.hash, coalesce(l.parents, '') AS parents
        FROM members m JOIN nodes n ON n.node_id = m.node_id JOIN h ON h.node_id = m.node_id
        LEFT JOIN lists l ON l.node_id = m.node_id"""


def proof_verdict_sql(ids: str) -> str:
    return f"""
        WITH {CATALOG}, {hash_chain("h")}, {hash_chain("t", POISON)}, ids AS ({ids})
        SELECT i.node_id AS target, t.hash = h.hash AS valid,
               CASE WHEN t.hash = h.hash THEN 'Integrity confirmed' ELSE 'TAMPER DETECTED!' END AS message
        FROM ids i JOIN h ON h.node_id = i.node_id JOIN t ON t.node_id = i.node_id"""


SYNTHETIC_SIZE = "size AS (SELECT count(*) AS n FROM part), ids AS (SELECT p_partkey AS i FROM part)"

ORACLE: dict[str, str] = {
    "catalog_nodes": f"WITH {NODES} SELECT node_id, node_type, 'unknown' AS creator, 'name=' || name || ';' AS content FROM nodes",
    "catalog_edges": f"WITH {EDGES} SELECT src, dst, round(weight, 6) AS weight FROM edges",
    "latest_artifacts": """
        SELECT 'user_' || user_id AS node_id, 'tool' AS node_type, 'unknown' AS creator,
               'kind=' || arg_max(event_type, event_id) || ';origin=events;' AS content, max(event_id) AS seq
        FROM events GROUP BY user_id""",
    "latest_edges": """
        SELECT 'user_' || user_id AS src, 'kind_' || event_type AS dst,
               round(greatest(0.0, least(1.0, arg_max(value, event_id) / 50)), 6) AS weight, max(event_id) AS seq
        FROM events GROUP BY user_id, event_type""",
    "content_edits": f"WITH {NODES}, {SEEDS} SELECT node_id, 'name=' || name || ';' || {POISON} AS content FROM nodes n",
    "node_lookup": f"WITH {NODES}, {SEEDS} SELECT n.node_id, node_type, name FROM nodes n JOIN seeds s ON s.node_id = n.node_id",
    "node_children": f"WITH {CATALOG} SELECT s.node_id, e.dst AS child, round(weight, 6) AS weight "
    "FROM seeds s JOIN edges e ON e.src = s.node_id",
    "node_parents": f"WITH {EDGES}, ids AS ({FIRST_CUSTOMERS}) SELECT i.node_id, e.src AS parent, round(weight, 6) AS weight "
    "FROM ids i JOIN edges e ON e.dst = i.node_id",
    "parent_lists": f"WITH {EDGES}, {LISTS} SELECT node_id, part, parents, n FROM lists",
    "known_ids": "SELECT 'supplier_' || c_custkey AS node_id, c_custkey IN (SELECT s_suppkey FROM supplier) AS known FROM customer",
    "edge_weights": f"""
        WITH {EDGES}, pairs AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)
        SELECT p.src, p.dst, round(coalesce(e.weight, 0.9), 6) AS weight
        FROM pairs p LEFT JOIN edges e ON e.src = p.src AND e.dst = p.dst""",
    "degrees": f"""
        WITH {CATALOG}
        SELECT n.node_id, coalesce(i.d, 0) AS in_degree, coalesce(o.d, 0) AS out_degree FROM nodes n
        LEFT JOIN (SELECT dst, count(*) AS d FROM edges GROUP BY dst) i ON i.dst = n.node_id
        LEFT JOIN (SELECT src, count(*) AS d FROM edges GROUP BY src) o ON o.src = n.node_id""",
    "graph_stats": f"""
        WITH {CATALOG}, {risk_chain()}
        SELECT count(*) AS total_nodes, (SELECT count(*) FROM edges) AS total_edges,
               (SELECT count(*) FROM nodes WHERE node_id NOT IN (SELECT dst FROM edges)) AS root_nodes,
               (SELECT count(*) FROM nodes WHERE node_id NOT IN (SELECT src FROM edges)) AS leaf_nodes,
               (SELECT count(*) FROM seeds) AS compromised_nodes, round(avg(risk), 4) AS mean_risk,
               round(greatest(0.0, max(risk)) + 1e-9, 6) AS max_risk, round(least(1.0, min(risk)) + 1e-9, 6) AS min_risk, {LEVEL_CELLS}
        FROM scores""",
    "build_summary": f"""
        WITH RECURSIVE {CATALOG}, {LAYERS}
        SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges,
               (SELECT max(layer) + 1 FROM layers) AS layers, (SELECT count(*) FROM layers) AS hashed""",
    "invalid_edges": f"""
        WITH {CATALOG}, wrong AS (SELECT 'customer_' || c_custkey AS src, 'nation_' || (c_nationkey + 10) AS dst FROM customer)
        SELECT src, dst, 'target not found' AS problem FROM wrong WHERE dst NOT IN (SELECT node_id FROM nodes)""",
    "missing_seeds": "SELECT 'supplier_' || c_custkey AS node_id FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
    "topo_layers": f"WITH RECURSIVE {CATALOG}, {LAYERS} SELECT node_id, layer FROM layers",
    "topo_order": f"""
        WITH RECURSIVE {CATALOG}, {LAYERS}
        SELECT node_id, layer, row_number() OVER (ORDER BY layer, node_id) - 1 AS position FROM layers""",
    "block_layers": f"WITH RECURSIVE {BLOCKS}, {LAYERS} SELECT node_id, layer FROM layers",
    "cycle_nodes": cycle_sql(" AND l_quantity = 50"),
    "merkle_hashes": f"WITH {CATALOG}, {hash_chain('h')} SELECT node_id, hash FROM h",
    "hash_listing": f"""
        WITH {CATALOG}, {hash_chain("h")}
        , {LISTS}
        SELECT h.node_id, coalesce(l.part, 0) AS part, h.hash, coalesce(l.parents, '') AS parents
        FROM h LEFT JOIN lists l ON l.node_id = h.node_id""",
    "refreshed_hashes": f"WITH {CATALOG}, {hash_chain('t', POISON)} SELECT node_id, hash FROM t",
    "refresh_report": f"""
        WITH {CATALOG}, {hash_chain("h")}, {hash_chain("t", POISON)}
        SELECT count(*) AS recomputed, count(*) AS changed FROM h JOIN t ON t.node_id = h.node_id WHERE t.hash <> h.hash""",
    "tamper_check": f"""
        WITH {CATALOG}, {hash_chain("h")}, {hash_chain("t", POISON)}
        SELECT h.node_id, h.hash AS expected, t.hash AS current, t.hash <> h.hash AS tampered FROM h JOIN t ON t.node_id = h.node_id""",
    "hash_diff": f"""
        WITH {CATALOG}, {hash_chain("h")}, {hash_chain("t", POISON)}
        SELECT h.node_id, CASE WHEN t.hash = h.hash THEN 'unchanged' ELSE 'changed' END AS state FROM h JOIN t ON t.node_id = h.node_id""",
    "proof_targets": proof_targets_sql(FIRST_CUSTOMERS),
    "proof_rows": proof_rows_sql(FIRST_CUSTOMERS),
    "proof_verdict": proof_verdict_sql(FIRST_CUSTOMERS),
    "risk_scores": f"WITH {CATALOG}, {risk_chain()} SELECT node_id, round(risk + 1e-9, 6) AS risk, {level('risk')} AS risk_level FROM scores",
    "risk_levels": f"""
        WITH {CATALOG}, {risk_chain()}, names(risk_level) AS (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('SAFE'))
        SELECT n.risk_level, count(s.node_id) AS nodes FROM names n LEFT JOIN scores s ON {level("s.risk")} = n.risk_level
        GROUP BY n.risk_level""",
    "risk_summary": f"""
        WITH {CATALOG}, {risk_chain()}
        SELECT count(*) AS total_nodes, round(avg(risk), 4) AS mean_risk, round(greatest(0.0, max(risk)) + 1e-9, 6) AS max_risk,
               round(least(1.0, min(risk)) + 1e-9, 6) AS min_risk, {LEVEL_CELLS} FROM scores""",
    "risk_topk": f"""
        WITH {CATALOG}, {risk_chain()}
        SELECT node_id, risk, {level("risk")} AS risk_level FROM even ORDER BY risk DESC, node_id LIMIT 20""",
    "risk_of_customers": f"""
        WITH {CATALOG}, {risk_chain()}
        SELECT node_id, risk, {level("risk")} AS risk_level FROM even WHERE starts_with(node_id, 'customer_')""",
    "diffuse_rounds": f"""
        WITH {CATALOG},
        d0 AS (SELECT n.node_id, coalesce(s.p, 0.0) AS risk FROM nodes n LEFT JOIN seeds s ON s.node_id = n.node_id),
        p1 AS (SELECT e.dst, 1.0 - product(1.0 - e.weight * d.risk) AS pushed FROM edges e JOIN d0 d ON d.node_id = e.src GROUP BY e.dst),
        d1 AS (SELECT d.node_id, greatest(d.risk, 0.85 * coalesce(p.pushed, 0.0) + (1.0 - 0.85) * d.risk) AS risk
               FROM d0 d LEFT JOIN p1 p ON p.dst = d.node_id),
        p2 AS (SELECT e.dst, 1.0 - product(1.0 - e.weight * d.risk) AS pushed FROM edges e JOIN d1 d ON d.node_id = e.src GROUP BY e.dst),
        d2 AS (SELECT d.node_id, greatest(d.risk, 0.85 * coalesce(p.pushed, 0.0) + (1.0 - 0.85) * d.risk) AS risk
               FROM d1 d LEFT JOIN p2 p ON p.dst = d.node_id)
        SELECT node_id, round(risk + 1e-9, 6) AS risk FROM d2""",
    "impacted_k": f"WITH {CATALOG}, {risk_chain()}, {walk('w', SEED_IDS, 'src', 'dst', 2)} {impact_rows('w.hops')}",
    "impacted_all": f"""
        WITH {CATALOG}, {risk_chain()}, {walk("w", "SELECT 'supplier_7' AS node_id", "src", "dst", DEEPEST)}
        {impact_rows("NULL::INTEGER")}""",
    "ancestors_k": f"WITH {CATALOG}, {risk_chain()}, {walk('w', ALL_CUSTOMERS, 'dst', 'src', 2)} {impact_rows('w.hops')}",
    "ancestors_all": f"""
        WITH {CATALOG}, {risk_chain()}, {walk("w", FIRST_CUSTOMERS, "dst", "src", DEEPEST)} {impact_rows("NULL::INTEGER")}""",
    "impact_query": f"""
        WITH {CATALOG}, {walk("w", SEED_IDS, "src", "dst", 2)}
        SELECT s.node_id AS source, 2::BIGINT AS k, count(w.node_id) AS total_impacted
        FROM seeds s LEFT JOIN w ON w.query_id = s.node_id GROUP BY s.node_id""",
    "khop_sweep": f"""
        WITH {CATALOG}, {walk("w", SEED_IDS, "src", "dst", 3)}, steps(k) AS (VALUES (1), (2), (3))
        SELECT s.node_id AS query_id, k::BIGINT AS k, count(w.node_id) AS impacted
        FROM seeds s CROSS JOIN steps LEFT JOIN w ON w.query_id = s.node_id AND w.hops <= k GROUP BY s.node_id, k""",
    "can_reach_pairs": f"""
        WITH {CATALOG}, {HOME_PAIRS}, {walk("w", ALL_NATIONS, "src", "dst", DEEPEST)}
        SELECT p.src, p.dst, w.node_id IS NOT NULL AS reachable
        FROM pairs p LEFT JOIN w ON w.query_id = p.src AND w.node_id = p.dst""",
    "indexed_reach": f"""
        WITH {CATALOG}, {HOME_PAIRS}, {walk("w", ALL_NATIONS, "src", "dst", DEEPEST)}
        SELECT p.src, p.dst, w.node_id IS NOT NULL AS reachable
        FROM pairs p LEFT JOIN w ON w.query_id = p.src AND w.node_id = p.dst""",
    "reach_report": f"""
        WITH {CATALOG}, {HOME_PAIRS}, {walk("w", ALL_NATIONS, "src", "dst", DEEPEST)}, {label_chain()}
        SELECT p.src, p.dst, w.node_id IS NOT NULL AS reachable,
               a.disc AS src_disc, a.fin AS src_fin, b.disc AS dst_disc, b.fin AS dst_fin
        FROM pairs p LEFT JOIN w ON w.query_id = p.src AND w.node_id = p.dst
        JOIN labels a ON a.node_id = p.src JOIN labels b ON b.node_id = p.dst""",
    "shortest_paths": f"""
        WITH RECURSIVE {BLOCKS},
        pairs AS (SELECT 'part_' || (p_partkey // 16 * 16) AS src, 'part_' || p_partkey AS dst FROM part
                  UNION SELECT 'part_' || p_partkey, 'part_' || (p_partkey // 16 * 16) FROM part),
        trails AS (
          SELECT DISTINCT src AS first, src AS node_id, [src] AS path FROM pairs WHERE src IN (
            SELECT 'part_' || (p_partkey // 16 * 16) FROM part)
          UNION ALL SELECT t.first, e.dst, list_append(t.path, e.dst) FROM trails t JOIN edges e ON e.src = t.node_id),
        best AS (SELECT first, node_id, min(struct_pack(n := len(path), path := path)) AS b FROM trails GROUP BY first, node_id)
        SELECT p.src, p.dst, t.b IS NOT NULL OR p.src = p.dst AS reachable,
               CASE WHEN p.src = p.dst THEN p.src ELSE coalesce(array_to_string(t.b.path, '>'), '') END AS path,
               coalesce(t.b.n - 1, 0)::BIGINT AS hops
        FROM pairs p LEFT JOIN best t ON t.first = p.src AND t.node_id = p.dst""",
    "catalog_paths": catalog_path_sql(),
    "impact_report": report_sql(),
    "interval_labels": f"WITH {CATALOG}, {label_chain()} SELECT node_id, disc, fin FROM labels",
    "interval_members": f"""
        WITH {CATALOG}, {label_chain()}
        SELECT q.node_id AS query_id, m.node_id FROM labels q JOIN labels m ON q.disc < m.disc AND m.fin <= q.fin
        WHERE starts_with(q.node_id, 'nation_')""",
    "synthetic_nodes": f"""
        WITH {SYNTHETIC_SIZE}
        SELECT 'node_' || i AS node_id, ['dataset', 'tool', 'model', 'model', 'model', 'product'][1 + i % 6] AS node_type,
               'name=Artifact-' || i || ';version=' || (i % 10) || ';' AS content, 'org_' || (i % 20) AS creator FROM ids""",
    "synthetic_edges": f"""
        WITH {SYNTHETIC_SIZE},
        extra AS (
          SELECT i, s.step, (i * 7919 + s.step * 104729) % 1000003 AS draw
          FROM ids CROSS JOIN (SELECT unnest(range(2, 11)) AS step) s WHERE i + s.step < (SELECT n FROM size)),
        picked AS (
          SELECT * FROM (SELECT *, row_number() OVER (ORDER BY draw, i, step) AS pos FROM extra)
          WHERE pos <= 2 * (SELECT n FROM size))
        SELECT 'node_' || i AS src, 'node_' || (i + 1) AS dst, round(0.5::DOUBLE + (i * 37 % 1000) / 2000.0::DOUBLE, 6) AS weight
        FROM ids WHERE i < (SELECT n FROM size) - 1
        UNION ALL
        SELECT 'node_' || i, 'node_' || (i + step), round(0.3::DOUBLE + ((i * 53 + step * 29) % 600) / 1000.0::DOUBLE, 6) FROM picked""",
    "synthetic_layers": f"""
        WITH {SYNTHETIC_SIZE} SELECT 'node_' || i AS node_id, i::BIGINT AS layer FROM ids""",
    "root_nodes": f"WITH {CATALOG} SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT dst FROM edges)",
    "leaf_nodes": f"WITH {CATALOG} SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT src FROM edges)",
    "seed_nodes": f"WITH {SEEDS} SELECT node_id, p AS probability FROM seeds",
    "invalid_nodes": """
        SELECT 'customer_' || c_custkey AS subject, 'artifact type not allowed: ' || lower(c_mktsegment) AS problem
        FROM customer WHERE lower(c_mktsegment) NOT IN ('dataset', 'tool', 'model', 'product')""",
    "risk_ranking": f"WITH {CATALOG}, {risk_chain()} SELECT node_id, risk, {level('risk')} AS risk_level FROM even",
    "compromise_answer": f"""
        WITH {CATALOG}, {risk_chain()}
        SELECT count(*) AS total_nodes, round(avg(risk), 4) AS mean_risk, round(greatest(0.0, max(risk)) + 1e-9, 6) AS max_risk,
               round(least(1.0, min(risk)) + 1e-9, 6) AS min_risk, {LEVEL_CELLS},
               (SELECT string_agg(node_id, '>' ORDER BY risk DESC, node_id)
                FROM (SELECT * FROM even ORDER BY risk DESC, node_id LIMIT 5)) AS highest
        FROM scores""",
    "extended_catalog": f"""
        WITH {CATALOG},
        batch AS (SELECT 'part_' || p_partkey AS src, 'order_' || o_orderkey AS dst, 0.25::DOUBLE AS weight
                  FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part))
        SELECT src, dst, round(weight, 6) AS weight FROM edges WHERE (src, dst) NOT IN (SELECT (src, dst) FROM batch)
        UNION ALL SELECT DISTINCT src, dst, round(weight, 6) FROM batch""",
    "path_check": f"""
        WITH {CATALOG}, trail AS (SELECT 'supplier_' || l_suppkey AS a, 'part_' || l_partkey AS b, 'order_' || (l_orderkey + 1) AS c FROM lineitem)
        SELECT DISTINCT a AS src, c AS dst, 2::BIGINT AS step, b AS at, c AS next FROM trail
        WHERE (b, c) NOT IN (SELECT (src, dst) FROM edges)""",
    "diffusion_stop": diffusion_sql(),
}

# For the queries over all ids and the whole answers.
WHOLE_ORACLE: dict[str, str] = {
    "every_parent": f"WITH {EDGES}, ids AS ({ALL_CUSTOMERS}) SELECT i.node_id, e.src AS parent, round(weight, 6) AS weight "
    "FROM ids i JOIN edges e ON e.dst = i.node_id",
    "every_cycle_node": cycle_sql(),
    "every_cycle_member": f"""
        WITH RECURSIVE {CATALOG},
        back AS (SELECT DISTINCT 'order_' || l_orderkey AS o, 'part_' || l_partkey AS p FROM lineitem WHERE l_returnflag = 'R'),
        hop AS (SELECT DISTINCT e.src AS p, b.p AS q FROM edges e JOIN back b ON b.o = e.dst WHERE starts_with(e.src, 'part_')),
        reach AS (SELECT p, q FROM hop UNION SELECT r.p, h.q FROM reach r JOIN hop h ON h.p = r.q),
        parts AS (SELECT a.p AS node_id, min(a.q) AS least FROM reach a JOIN reach b ON a.p = b.q AND a.q = b.p GROUP BY a.p),
        orders_on AS (SELECT DISTINCT b.o AS node_id, c.least FROM edges e JOIN back b ON b.o = e.dst
                      JOIN parts c ON c.node_id = e.src JOIN parts d ON d.node_id = b.p AND d.least = c.least),
        members AS (SELECT * FROM parts UNION ALL SELECT * FROM orders_on)
        SELECT node_id, min(node_id) OVER (PARTITION BY least) AS component, count(*) OVER (PARTITION BY least) AS size FROM members""",
    "every_proof_target": proof_targets_sql(ALL_CUSTOMERS),
    "every_proof_row": proof_rows_sql(ALL_CUSTOMERS),
    "every_proof_verdict": proof_verdict_sql(ALL_CUSTOMERS),
    "every_impact": f"""
        WITH {CATALOG}, {risk_chain()}, {walk("w", ALL_SUPPLIERS, "src", "dst", DEEPEST)} {impact_rows("NULL::INTEGER")}""",
    "every_ancestor": f"""
        WITH {CATALOG}, {risk_chain()}, {walk("w", ALL_CUSTOMERS, "dst", "src", DEEPEST)} {impact_rows("NULL::INTEGER")}""",
    "every_catalog_path": catalog_path_sql(ALL_PAIRS),
    "every_interval_member": f"""
        WITH {CATALOG}, {label_chain()}
        SELECT q.node_id AS query_id, m.node_id FROM labels q JOIN labels m ON q.disc < m.disc AND m.fin <= q.fin""",
    "impact_query_rows": f"""
        WITH {CATALOG}, {risk_chain()}, {walk("w", SEED_IDS, "src", "dst", 2)}
        SELECT w.query_id, w.node_id, n.node_type, r.risk, w.hops::BIGINT AS hops
        FROM w JOIN nodes n ON n.node_id = w.node_id JOIN even r ON r.node_id = w.node_id""",
    "diffusion_scores": diffusion_rows_sql(),
    "impact_report_rows": report_rows_sql(),
}
