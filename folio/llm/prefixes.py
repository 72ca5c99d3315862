"""A trie over the turns of conversations, built family by family.

A family is all conversations of one base id (conv_id - conv_id % 100), so it has 100 ids at most (199 around zero). Texts stay
behind: a turn travels as two hashes of its role and text and the text's length. The base conversation and the others of its
family are cogrouped; each is rebuilt and put into the family's trie. Only combined nodes (one a family and prefix, however many
conversations share it) are shuffled on, keyed by a digest of the whole prefix.

Sums over subtrees are made without walking the global trie. Each node is owned by the least family that has it; a family adds
up what it owns below every node of its own trie, and since the owner of a node has all its ancestors too, the families' sums
add up to the global ones. Lists of ids are packed a thousand families at a time and streamed through one hash a node.

Cases: a row without conv_id belongs to no conversation; a missing role or text is empty; turns of equal number, missing ones
first, are ordered by their hashes, and repeated rows are turns of their own; a conversation whose turns all fall into the
part that the base replaces may be turnless and is still a member of the root; an empty table has no nodes; other columns
are ignored. Remainders have the sign of the id, as in SQL. A family's task holds some 60 bytes a turn, whatever the texts' sizes.
"""

from __future__ import annotations

import hashlib
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import checkpoint

FAMILY = 100
HEADS = 6
#: Families whose lists of ids are packed into one string.
PACK = 1000
#: A node with more than 1 / HOT of all nodes as children is looked up by broadcast; there are fewer than HOT such nodes.
HOT = 1000
ROOT = b""

NODES = "node binary, parent binary, depth long, base long, conv_id long, n long, own long, below long, leaf boolean, ends string"
SHARES = "node binary, parent binary, depth long, conv_id long, n long, kids long, leaves long, saved long"

REPORT_SQL = """
WITH RECURSIVE turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, list(t ORDER BY n) AS own FROM turns GROUP BY conv_id),
crc AS (
  SELECT conv_id, own, (4294967295 - list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h FROM convs),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(list_slice(b.own, 1, c.h), []), list_slice(c.own, c.h + 1, len(c.own))) AS path
  FROM crc c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 100),
steps AS (SELECT conv_id, path, d, list_slice(path, 1, d) AS p FROM rebuilt, unnest(range(0, len(path) + 1)) AS u(d)),
nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n,
    string_agg(CASE WHEN len(path) = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends,
    CASE WHEN d = 0 THEN 0 ELSE length(p[d].text) END AS own
  FROM steps GROUP BY p, d),
kids AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
flat AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN kids USING (p)),
below AS (
  SELECT list_slice(p, 1, a) AS p, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * own) AS saved
  FROM flat, unnest(range(0, d + 1)) AS u(a) GROUP BY ALL)
SELECT flat.conv_id, flat.d AS depth, up.conv_id AS parent_conv_id, flat.n AS n_convs, flat.k AS n_children, leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, sha256(coalesce(flat.ends, '')) AS ends_sha256
FROM flat JOIN below USING (p) LEFT JOIN nodes up ON flat.d > 0 AND up.p = list_slice(flat.p, 1, flat.d - 1)
"""


def turns(conversations: DataFrame) -> DataFrame:
    """(base, conv_id, dated, turn, x, y, size): every turn as two hashes and the code points of its text."""
    c = conversations
    role, text = (F.coalesce(c[n].cast("string"), F.lit("")) for n in ("role", "text"))
    rows = c.select(
        c["conv_id"].cast("long").alias("conv_id"),
        c["turn"].isNotNull().alias("dated"),
        F.coalesce(c["turn"].cast("long"), F.lit(0)).alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("x"),
        F.xxhash64(F.lit(2), role, text).alias("y"),
        F.char_length(text).cast("long").alias("size"),
    )
    return rows.where("conv_id IS NOT NULL").withColumn("base", F.expr(f"conv_id - conv_id % {FAMILY}"))


def head(conv_id: int) -> int:
    """How many turns of the base stand before a conversation's own."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def rebuilt(base: int, rows: pd.DataFrame) -> list[tuple[int, list]]:
    """A family's conversations by ascending id, each with its turns (x, y, size)."""
    rows = rows.sort_values(["conv_id", "dated", "turn", "x", "y"])
    own: dict[int, list] = {}
    for c, *turn in zip(rows["conv_id"].tolist(), rows["x"].tolist(), rows["y"].tolist(), rows["size"].tolist(), strict=True):
        own.setdefault(c, []).append(turn)
    return [(c, own.get(base, [])[: head(c)] + own[c][head(c) :]) for c in sorted(own)]


def family_trie(key: tuple, base_rows: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one family's trie, with what they hold of this family."""
    base = int(key[0])
    found: dict[tuple, int] = {}
    nodes = [[ROOT, None, 0, base, None, 0, 0, 0, True, []]]
    parents = [-1]
    for c, path in rebuilt(base, pd.concat([base_rows, rows])):
        at = 0
        for depth in range(len(path) + 1):
            if depth:
                x, y, size = path[depth - 1]
                step = (at, x, y)
                if step not in found:
                    found[step] = len(nodes)
                    above = nodes[at]
                    above[8] = False
                    name = hashlib.blake2b(above[0] + x.to_bytes(8, "big", signed=True) + y.to_bytes(8, "big", signed=True), digest_size=16)
                    nodes.append([name.digest(), above[0], depth, base, None, 0, size, 0, True, []])
                    parents.append(at)
                at = found[step]
            node = nodes[at]
            node[4] = c if node[4] is None else node[4]
            node[5] += 1
        nodes[at][9].append(str(c))
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        node[7] += node[5] * node[6]
        if i:
            nodes[parents[i]][7] += node[7]
        node[9] = ",".join(node[9])
    return pd.DataFrame(nodes, columns=["node", "parent", "depth", "base", "conv_id", "n", "own", "below", "leaf", "ends"])


def family_share(key: tuple, nodes: pd.DataFrame, owned: pd.DataFrame) -> pd.DataFrame:
    """What one family adds to the global sums of each of its nodes: of distinct nodes it counts those that it owns."""
    mine = dict(zip(owned["node"], owned["leaf"], strict=True))
    nodes = nodes.sort_values("depth", ascending=False)
    out = {}
    for node, parent, depth, conv_id, n, own, below in nodes[["node", "parent", "depth", "conv_id", "n", "own", "below"]].itertuples(index=False):
        out[node] = [node, parent, depth, conv_id, n, 0, int(mine.get(node, False)), below - (own if node in mine else 0), own if node in mine else 0]
    # Deepest first: a node is complete when its turn comes.
    for node, row in out.items():
        if row[1] is not None:
            up = out[row[1]]
            up[5] += node in mine
            up[6] += row[6]
            up[7] -= row[8]
            up[8] += row[8]
    return pd.DataFrame([row[:8] for row in out.values()], columns=["node", "parent", "depth", "conv_id", "n", "kids", "leaves", "saved"])


def hashes(batches):
    """(node, ends_sha256) of rows that come by node and in order: one running hash, nothing gathered."""
    node, running = None, None
    for batch in batches:
        done = []
        for at, ids in zip(batch["node"], batch["ids"], strict=True):
            if at != node:
                if running is not None:
                    done.append((node, running.hexdigest()))
                node, running = at, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.encode())
        yield pd.DataFrame(done, columns=["node", "ends_sha256"])
    if running is not None:
        yield pd.DataFrame([(node, running.hexdigest())], columns=["node", "ends_sha256"])


def end_hashes(nodes: DataFrame) -> DataFrame:
    """The hash of the ids that end at each node."""
    pack = F.floor(F.col("base") / (FAMILY * PACK)).alias("pack")
    packed = nodes.where("ends <> ''").groupBy("node", pack).agg(F.array_sort(F.collect_list(F.struct("base", "ends"))).alias("all"))
    packed = packed.select("node", "pack", F.array_join("all.ends", ",").alias("ids"))
    return packed.repartition("node").sortWithinPartitions("node", "pack").mapInPandas(hashes, "node binary, ends_sha256 string")


def with_parents(nodes: DataFrame) -> DataFrame:
    """Each node with parent_conv_id. Parents of very many children are few and are broadcast, so no key of the join is crowded."""
    up = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = F.broadcast(up.where(F.col("n_children") * HOT > nodes.count()).drop("n_children"))
    few = nodes.join(hot.select("parent"), "parent", "left_anti").join(up.drop("n_children"), "parent", "left")
    return nodes.join(hot, "parent").unionByName(few)


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node of the global trie."""
    rows = turns(conversations)
    of_base = F.col("conv_id") == F.col("base")
    families = rows.where(of_base).groupBy("base").cogroup(rows.where(~of_base).groupBy("base"))
    nodes = checkpoint(families.applyInPandas(family_trie, NODES))
    owned = nodes.groupBy("node").agg(F.min("base").alias("base"), F.bool_and("leaf").alias("leaf"))
    shares = nodes.drop("ends").groupBy("base").cogroup(owned.groupBy("base")).applyInPandas(family_share, SHARES)
    total = checkpoint(
        shares.groupBy("node").agg(
            F.min("parent").alias("parent"),
            F.min("conv_id").alias("conv_id"),
            F.min("depth").alias("depth"),
            F.sum("n").alias("n_convs"),
            F.sum("kids").alias("n_children"),
            F.sum("leaves").alias("n_leaves"),
            F.sum("saved").alias("saved_tokens"),
        )
    )
    nothing = F.lit(hashlib.sha256().hexdigest())
    out = with_parents(total).join(end_hashes(nodes), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
