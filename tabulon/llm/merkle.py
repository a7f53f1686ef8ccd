"""Merkle dataset manifest by butterfly exchange.

The leaves of a group are cut into partitions: aligned runs of 512. Each builds the
lower levels of its own tree. Then, round by round, every partition swaps its current
root with the seven others whose number differs in one octal digit: it keeps their
digests as the next part of its proofs and hashes the common ancestor itself, as they
all do. After as many rounds as the number of partitions has octal digits, every
partition holds its upper proofs and the root, without any pass downwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulon.llm.common import written

FANOUT = 8
#: Levels that a partition builds by itself, and the leaves it holds.
LEVELS = 3
LEAVES = FANOUT**LEVELS
#: Columns of a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: A partition's row of its group is dealt out over so many copies.
SALTS = 64
PATH = "array<struct<left:string,right:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def height(nodes: int) -> int:
    """Levels above so many nodes: none above a single one."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // FANOUT), levels + 1
    return levels


def tree(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and so many levels above them; the last run of a level may be short."""
    out = [nodes]
    for _ in range(levels):
        out.append([digest("".join(out[-1][i : i + FANOUT])) for i in range(0, len(out[-1]), FANOUT)])
    return out


def sides(levels: list[list[str]], at: int) -> Iterator[tuple[str, str]]:
    """Of the leaf ``at`` and its ancestors: the digests left and right of each in its run."""
    for nodes in levels[:-1]:
        start = at - at % FANOUT
        yield "".join(nodes[start:at]), "".join(nodes[at + 1 : start + FANOUT])
        at //= FANOUT


def fold(leaf: str, path: Sequence[tuple[str, str]]) -> str:
    """The root that a leaf leads to, given the digests beside it and its ancestors."""
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


def leaf_digest(columns: Sequence[Column]) -> Column:
    """Digest of a row: of each value its number of UTF-8 bytes, a colon and the value; ``-`` for a null."""
    parts = [c.cast("string") for c in columns]
    coded = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in parts]
    return F.sha2(F.concat(*coded).cast("binary"), 256)


def group_key(column: Column) -> Column:
    """A key without nulls in the order of the values' bytes, null first."""
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), column.cast("string")))


def placed(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add to rows with ``g`` (group): ``pos`` (long, from 0 in the order of the group),
    ``n`` (leaves of the group) and ``block`` (its partition).

    Rows are dealt out by ranges and numbered where they lie; equal ones by chance, so
    that no range is too large. The numbered rows are written, so that they stay.
    """
    keys = ["g", *order]
    ranged = leaves.withColumn("__chance", F.rand(5)).repartitionByRange(*keys, "__chance").sortWithinPartitions(*keys, "__chance").drop("__chance")
    rows = written(ranged.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}), "ranked")
    runs = rows.groupBy("g", "__part").agg(F.min("__row").alias("__first"), F.count("*").alias("__size"))
    whole = Window.partitionBy("g")
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("g", "__part", (F.coalesce(F.sum("__size").over(before), F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__size").over(whole).alias("n"))
    out = rows.join(starts, ["g", "__part"]).withColumn("pos", F.col("__row") + F.col("__shift"))
    return out.withColumn("block", F.expr(f"pos div {LEAVES}")).drop("__part", "__row", "__shift")


def partition_roots(rows: DataFrame) -> DataFrame:
    """``g``, ``block``, ``parts`` (partitions of the group) and the partition's own root."""

    def root(table: pa.Table) -> pa.Table:
        pos, leaf = table["pos"].to_pylist(), table["leaf"].to_pylist()
        n = table["n"][0].as_py()
        levels = tree([x for _, x in sorted(zip(pos, leaf))], min(LEVELS, height(n)))
        return pa.table({"g": table["g"][:1], "block": table["block"][:1], "parts": pa.array([-(-n // LEAVES)], pa.int64()), "digest": [levels[-1][0]]})

    return rows.select("g", "block", "n", "pos", "leaf").groupBy("g", "block").applyInArrow(root, "g string, block long, parts long, digest string")


def butterfly(roots: DataFrame) -> DataFrame:
    """Upper proofs of all partitions: ``g``, ``block``, ``path`` and ``subroot``.

    Partitions are padded to whole subtrees of the group's top level, at most twice as
    many; padding has no digest of its own, learns its ancestors like the rest and
    passes them on. Each round is one exchange of eight rows a partition, written to
    the shared folder.
    """
    roots = written(roots, "roots")
    rounds = height(roots.agg(F.max("parts")).first()[0] or 0)
    unit = F.lit(1).cast("long")
    for r in range(1, rounds):
        unit = F.when(F.col("parts") > FANOUT**r, F.lit(FANOUT**r).cast("long")).otherwise(unit)
    state = roots.select("g", "block", "parts", "digest", F.array().cast(PATH).alias("path")).withColumn("padded", F.ceil(F.col("parts") / unit) * unit)
    groups = state.where("block = 0 AND padded > parts")
    padding = groups.select("g", F.explode(F.expr("sequence(parts, padded - 1)")).alias("block"), "parts", F.lit(None).cast("string").alias("digest"), "path", "padded")
    state = written(state.unionByName(padding), "round")
    finished = []
    for r in range(rounds):
        step = FANOUT**r
        finished.append(state.where(F.col("parts") <= step))
        digit = F.expr(f"block div {step} % {FANOUT}")
        sent = state.where(F.col("parts") > step).withColumns({"digit": digit, "side": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FANOUT - 1).cast("long")))})
        sent = sent.withColumn("to", F.col("block") + (F.col("side") - F.col("digit")) * step).where("to < padded")
        met = sent.groupBy("g", F.col("to").alias("block")).agg(
            F.first("parts").alias("parts"),
            F.first("padded").alias("padded"),
            F.first(F.when(F.col("to") == F.col("block"), F.col("path")), ignorenulls=True).alias("path"),
            F.array_sort(F.collect_list(F.struct("digit", "digest"))).alias("nodes"),
        )
        left = F.filter("nodes", lambda x: x["digit"] < digit)
        right = F.filter("nodes", lambda x: x["digit"] > digit)
        beside = [F.array_join(F.transform(side, lambda x: x["digest"]), "") for side in (left, F.col("nodes"), right)]
        path = F.concat("path", F.array(F.struct(beside[0].alias("left"), beside[2].alias("right"))))
        ahead = met.select("g", "block", "parts", F.when(beside[1] != "", F.sha2(beside[1].cast("binary"), 256)).alias("digest"), F.when(F.col("block") < F.col("parts"), path).otherwise(F.col("path")).alias("path"), "padded")
        state = written(ahead, "round")
    for part in finished:
        state = state.unionByName(part)
    return state.where("block < parts").select("g", "block", "path", F.col("digest").alias("subroot"))


def group_paths(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Of every leaf its ``id``, whole ``path`` and the root of its group."""

    def collect(leaves: pa.Table, upper: pa.Table) -> pa.Table:
        found = sorted(zip(leaves["pos"].to_pylist(), leaves["leaf"].to_pylist(), leaves["id"].to_pylist()))
        levels = tree([x for _, x, _ in found], min(LEVELS, height(leaves["n"][0].as_py())))
        above = upper["path"][0].as_py()
        whole = [[{"left": a, "right": b} for a, b in sides(levels, k)] + above for k in range(len(found))]
        return pa.table({"id": [x for *_, x in found], "subroot": [x for _, x, _ in found], "top": pa.array(whole, upper.schema.field("path").type), "root": upper["subroot"].to_pylist() * len(found)})

    sides_of = rows.groupBy("g", "block").cogroup(paths.groupBy("g", "block"))
    return sides_of.applyInArrow(collect, f"id string, subroot string, top {PATH}, root string")


def prove(df: DataFrame, changed: dict[str, Column] | None = None, id_col: str = "doc_id", group_col: str = "lang", columns: Sequence[str] = COLUMNS, proofs: bool = False) -> DataFrame:
    """Manifest of all rows: ``id``, ``leaf``, ``subroot`` (of its group), ``root``,
    ``proof_sha256``, ``folded_root`` and ``verified``; with ``proofs`` also ``proof``, the
    digests left and right of the leaf and its ancestors.

    ``changed`` gives columns new values before the check: the leaf of the changed row
    is folded with the original proof and held against the root. Groups are the values
    of ``group_col`` in byte order, null first; leaves ascend by id, null first, then by
    digest. Repeated rows are leaves of their own, each with its own proof. Null values
    and empty texts have digests like any other. An empty table gives an empty one;
    columns not named are ignored.
    """
    values = {c: F.col(f"`{c}`") for c in columns}
    leaf = leaf_digest(list(values.values()))
    changed = changed or {}
    is_other = leaf_digest([changed.get(c, v) for c, v in values.items()]) if changed else leaf
    narrow = df.select(group_key(F.col(f"`{group_col}`")).alias("g"), F.col(f"`{id_col}`").alias("id"), leaf.alias("leaf"), is_other.alias("now"))
    rows = placed(written(narrow, "leaves"), ["id", "leaf", "now"])
    upper = written(butterfly(partition_roots(rows)), "paths")
    tops = placed(upper.where("block = 0").select(F.lit("").alias("g"), F.col("g").alias("id"), F.col("subroot").alias("leaf")), ["id"])
    top = written(group_paths(tops, butterfly(partition_roots(tops))), "tops")
    # one row a group meets all partitions of the group: salted, as one group may be most of the table
    salted = top.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).select(F.col("id").alias("g"), "salt", "top", "root")
    paths = upper.withColumn("salt", F.col("block") % SALTS).join(salted, ["g", "salt"]).select("g", "block", "path", "subroot", "top", "root")
    kind = dict(narrow.dtypes)["id"]

    def check(leaves: pa.Table, above: pa.Table) -> pa.Table:
        order = sorted(range(len(leaves)), key=leaves["pos"].to_pylist().__getitem__)
        mine, now = leaves["leaf"].to_pylist(), leaves["now"].to_pylist()
        levels = tree([mine[k] for k in order], min(LEVELS, height(leaves["n"][0].as_py())))
        upper_path = [(x["left"], x["right"]) for c in ("path", "top") for x in above[c][0].as_py()]
        subroot, root = above["subroot"][0].as_py(), above["root"][0].as_py()
        tail = "".join(a + b for a, b in upper_path)
        whole = [[*sides(levels, k), *upper_path] for k in range(len(order))]
        folded = [fold(now[k], path) for k, path in zip(order, whole)]
        cut = len(levels) - 1
        out = {
            "id": leaves["id"].combine_chunks().take(pa.array(order)),
            "leaf": [mine[k] for k in order],
            "subroot": [subroot] * len(order),
            "root": [root] * len(order),
            "proof_sha256": [digest("".join(a + b for a, b in path[:cut]) + tail) for path in whole],
            "folded_root": folded,
            "verified": [x == root for x in folded],
        }
        if proofs:
            out["proof"] = pa.array([[{"left": a, "right": b} for a, b in path] for path in whole], above.schema.field("path").type)
        return pa.table(out)

    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + f", proof {PATH}" * proofs
    return rows.groupBy("g", "block").cogroup(paths.groupBy("g", "block")).applyInArrow(check, schema)


def lower_cased(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _sql(depth: int = 8, top: int = 3) -> str:
    """The same rows in SQL, level by level, for groups of up to 8^depth leaves and 8^top groups."""
    coded = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = "xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295)"
    hashed = lambda t: "sha256(" + " || ".join(coded(c) if c != "text" else coded(t) for c in COLUMNS) + ")"
    parts = [
        f"rows0 AS (SELECT doc_id, coalesce('=' || lang, '-') AS g, {hashed('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {hashed(lower)} ELSE {hashed('text')} END AS now FROM documents)",
        "a0 AS (SELECT g, doc_id, leaf AS h, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM rows0)",
    ]

    def levels(name: str, count: int) -> None:
        for k in range(count):
            run = f"OVER (PARTITION BY g, pos // {FANOUT} ORDER BY pos ROWS BETWEEN"
            parts.append(f"{name}s{k} AS (SELECT g, pos, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lt, coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rt, n FROM {name}{k})")
            parts.append(f"{name}{k + 1} AS (SELECT g, pos // {FANOUT} AS pos, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE min(h) END AS h, (n + {FANOUT - 1}) // {FANOUT} AS n FROM {name}{k} GROUP BY g, pos // {FANOUT}, n)")

    levels("a", depth)
    parts.append(f"b0 AS (SELECT '' AS g, g AS lang, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM a{depth})")
    levels("b", top)
    proof, joins = [], []
    for name, count in (("a", depth), ("b", top)):
        for k in range(count):
            t = f"{name}s{k}"
            at = "a.pos" if name == "a" else "b.pos"
            joins.append(f"JOIN {t} ON {t}.pos = {at} // {FANOUT**k}" + (f" AND {t}.g = a.g" if name == "a" else ""))
            proof.append(f"CASE WHEN {t}.n > 1 THEN {t}.lt || {t}.rt ELSE '' END")
    names = [f"{name}s{k}" for name, count in (("a", depth), ("b", top)) for k in range(count)]
    parts.append(
        "joined AS (SELECT r.doc_id, r.leaf, r.now, s.h AS subroot, t.h AS root, sha256("
        + " || ".join(proof)
        + ") AS proof_sha256, "
        + ", ".join(f"{t}.n AS n_{t}, {t}.lt AS lt_{t}, {t}.rt AS rt_{t}" for t in names)
        + f" FROM rows0 r JOIN a0 a ON a.g = r.g AND a.doc_id IS NOT DISTINCT FROM r.doc_id AND a.h = r.leaf JOIN a{depth} s ON s.g = r.g JOIN b0 b ON b.lang = r.g CROSS JOIN b{top} t "
        + " ".join(joins)
        + ")"
    )
    last = "joined"
    for t in names:
        parts.append(f"f_{t} AS (SELECT * REPLACE (CASE WHEN n_{t} > 1 THEN sha256(lt_{t} || now || rt_{t}) ELSE now END AS now) FROM {last})")
        last = f"f_{t}"
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, proof_sha256, now AS folded_root, now = root AS verified FROM {last}"


#: The same rows in SQL; ids must not repeat there.
SQL = _sql()
