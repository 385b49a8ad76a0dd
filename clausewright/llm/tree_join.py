"""Equi join with hot keys by tree-join.

A key whose rows make up more pairs, or are more themselves, than a task should hold is hot. The rows
of a hot key form a list on each side, cut into sublists of about ``LIST`` rows. A node of the tree is
a pair of runs of sublists, left and right; it starts as the pair of both whole lists and splits, in
rounds, into at most ``FAN`` times ``FAN`` pairs of shorter runs, which are dealt out anew each round,
until every node is one sublist against one other. Rows meet only there, so no task gets more than two
sublists. All other keys take part in an ordinary join.

Whether a row's key is hot is looked up by a join in which hot keys come in ``SALTS`` copies, so the
rows of one key don't meet in one task there either. Nothing that grows with the input goes to the
driver or into a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, read

#: A key with more pairs, or with more rows on one side, is hot.
PAIRS = 4096
ROWS = 10_000
#: Rows of a sublist, on average.
LIST = 10_000
#: Parts into which a round splits each side of a node.
FAN = 16
SALTS = 32


class TreeJoin:
    """The rows of both sides, told apart by key, and the leaves of the tree.

    ``placed``: is_left, key, row, data (a struct of the side's columns, ``l`` or ``r``, the other
    null), kind and sub. Kinds are ``hot``, ``cold`` and ``alone``: keys that are null, or hot with
    rows on one side only.
    """

    def __init__(self, left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, left_columns: list[Column], right_columns: list[Column], pairs: int = PAIRS, rows: int = ROWS, list_rows: int = LIST):
        self.scratch = Scratch(left.sparkSession, "tree_join")
        self.list_rows = list_rows
        a = left.select(F.lit(True).alias("is_left"), left_key.alias("key"), F.struct(*left_columns).alias("l"), F.lit(None).alias("r"))
        b = right.select(F.lit(False).alias("is_left"), right_key.alias("key"), F.lit(None).alias("l"), F.struct(*right_columns).alias("r"))
        both = a.unionByName(b).withColumn("row", F.monotonically_increasing_id())
        counts = both.filter("key is not null").groupBy("key").agg(F.count_if("is_left").alias("n_left"), F.count_if(~F.col("is_left")).alias("n_right"))
        hot = counts.filter((F.col("n_left") * F.col("n_right") > pairs) | (F.greatest("n_left", "n_right") > rows))
        self.hot = self.scratch.table(hot, "hot")
        salted = self.hot.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        told = both.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS))).join(salted.hint("shuffle_hash"), ["key", "salt"], "left")
        lonely = F.col("key").isNull() | (F.when(F.col("is_left"), F.col("n_right")).otherwise(F.col("n_left")) == 0)
        kind = F.when(lonely, "alone").when(F.col("n_left").isNotNull(), "hot").otherwise("cold")
        own = F.when(F.col("is_left"), F.col("n_left")).otherwise(F.col("n_right"))
        sub = F.when(kind == "hot", F.pmod(F.xxhash64("row", F.lit("sub")), self._lists(own)))
        self.placed = self.scratch.table(told.select("is_left", "key", "row", "l", "r", kind.alias("kind"), sub.alias("sub")), "placed")
        self.leaves = self._split()
        self.scratch.keep("placed", "leaves")

    def _lists(self, n: Column) -> Column:
        return F.ceil(n / F.lit(self.list_rows)).cast("long")

    def _split(self) -> DataFrame:
        """key, i, j: every pair of a left and a right sublist of a hot key, by splitting in rounds."""
        zero = F.lit(0).cast("long")
        nodes = self.hot.filter("n_left > 0 and n_right > 0").select("key", zero.alias("i"), self._lists(F.col("n_left")).alias("i_end"), zero.alias("j"), self._lists(F.col("n_right")).alias("j_end"))
        longest = nodes.agg(F.max(F.greatest("i_end", "j_end")).alias("n")).first().n or 1  # one number
        k = 0
        while longest > 1:
            for at in ("i", "j"):
                step = F.greatest(F.ceil((F.col(f"{at}_end") - F.col(at)) / F.lit(FAN)), F.lit(1)).cast("long")
                nodes = nodes.withColumn("__step", step).withColumn("__from", F.explode(F.sequence(F.col(at), F.col(f"{at}_end") - 1, F.col("__step"))))
                nodes = nodes.withColumn(f"{at}_end", F.least(F.col(f"{at}_end"), F.col("__from") + F.col("__step"))).withColumn(at, F.col("__from")).drop("__step", "__from")
            nodes = self.scratch.table(nodes.repartition("key", "i", "j"), f"nodes-{k}")
            longest, k = -(-longest // FAN), k + 1
        return self.scratch.table(nodes.select("key", "i", "j"), "leaves")

    def of(self, kind: str, left: bool) -> DataFrame:
        return self.placed.filter((F.col("kind") == kind) & (F.col("is_left") == left))

    def cold(self) -> DataFrame:
        """key, l, r: the full outer join of rows without a hot key."""
        return self.of("cold", True).select("key", "l").join(self.of("cold", False).select("key", "r").hint("merge"), "key", "full")

    def rows(self, how: str = "inner") -> DataFrame:
        """key, l, r: the joined rows; ``how`` is inner, left, right or full."""
        left = self.of("hot", True).select("key", F.col("sub").alias("i"), "l").join(self.leaves.hint("shuffle_hash"), ["key", "i"])
        right = self.of("hot", False).select("key", F.col("sub").alias("j"), "r").join(self.leaves.hint("shuffle_hash"), ["key", "j"])
        met = left.join(right.hint("merge"), ["key", "i", "j"]).select("key", "l", "r")
        out = met.unionByName(self.cold()).unionByName(self.placed.filter("kind = 'alone'").select("key", "l", "r"))
        needed = {"inner": ("l", "r"), "left": ("l",), "right": ("r",), "full": ()}[how]
        return out.filter(" and ".join(f"{c} is not null" for c in needed)) if needed else out

    def partners(self, id_: str = "id", measure: str = "measure") -> DataFrame:
        """One row per side and distinct id: is_left, id, key, copies, met, outer, total.

        ``met`` counts the joined rows with a row of this id, ``outer`` those of an outer join that keeps
        this side, ``total`` sums the partners' ``measure`` over them. A leaf's rows all meet the same
        partners, so a leaf gives each of its sublists the other's count and sum, and no pair of a hot
        key is made one by one. The largest key is named where rows of one id have several.
        """
        side = lambda is_left, c, n, total, lone, copies: F.struct(F.lit(is_left).alias("is_left"), F.col(f"{c}.{id_}").alias("id"), "key", F.lit(copies).cast("long").alias("copies"), n.cast("long").alias("met"), lone.cast("long").alias("lone"), total.cast("long").alias("total"))
        zero = F.lit(0)

        def pair(is_left: bool, c: str, d: str) -> Column:
            found = F.col(d).isNotNull()
            return F.when(F.col(c).isNotNull(), side(is_left, c, found, F.coalesce(F.col(f"{d}.{measure}"), zero), ~found, 0))

        parts = [self.cold().select(F.explode(F.array_compact(F.array(pair(True, "l", "r"), pair(False, "r", "l")))).alias("s")).select("s.*")]
        for is_left, c, d, own, other in ((True, "l", "r", "i", "j"), (False, "r", "l", "j", "i")):
            lists = self.of("hot", not is_left).groupBy("key", F.col("sub").alias(other)).agg(F.count("*").alias("n"), F.sum(f"{d}.{measure}").alias("total"))
            given = self.leaves.join(lists.hint("shuffle_hash"), ["key", other]).groupBy("key", own).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
            met = self.of("hot", is_left).withColumn(own, F.col("sub")).join(given.hint("shuffle_hash"), ["key", own])
            parts.append(met.select(side(is_left, c, F.col("n"), F.col("total"), zero, 1).alias("s")).select("s.*"))
            parts.append(self.of("cold", is_left).select(side(is_left, c, zero, zero, zero, 1).alias("s")).select("s.*"))
            parts.append(self.of("alone", is_left).select(side(is_left, c, zero, zero, F.lit(1), 1).alias("s")).select("s.*"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.groupBy("is_left", "id").agg(F.max("key").alias("key"), F.sum("copies").alias("copies"), F.sum("met").alias("met"), (F.sum("met") + F.sum("lone")).alias("outer"), F.sum("total").alias("total"))


def tree_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", **bounds: int) -> DataFrame:
    """``on``, left, right: the joined rows, each side's row whole as a struct (null where it has no partner).

    Defined results: null keys match nothing and stay in outer joins; repeated rows all take part;
    empty tables give what an ordinary join gives; columns of both sides may have any names but must be
    told apart within their side.
    """
    made = TreeJoin(left, right, F.col(on), F.col(on), [F.col(f"`{c}`") for c in left.columns], [F.col(f"`{c}`") for c in right.columns], **bounds)
    return made.rows(how).select(F.col("key").alias(on), F.col("l").alias("left"), F.col("r").alias("right"))


def join_report(left: DataFrame, right: DataFrame, left_id: str, left_key: Column, left_value: str, right_id: str, right_key: Column, right_value: str, sides: tuple[str, str], **bounds: int) -> DataFrame:
    """side, id, client_id, copies, inner_rows, left_rows, full_rows, partner_crc, one row per side and distinct id.

    Defined results: as ``tree_join``; a row without partner adds nothing to ``partner_crc``; a null
    value leaves the cents of its string empty, a null id the digits; null ids are one id.
    """

    def columns(id_: str, value: str) -> list[Column]:
        cents = F.coalesce(F.floor(F.col(value).cast("double") * 100 + 0.5).cast("string"), F.lit(""))
        named = F.concat(F.coalesce(F.col(id_).cast("string"), F.lit("")), F.lit(":"), cents)
        return [F.col(id_).cast("long").alias("id"), F.crc32(named.cast("binary")).alias("measure")]

    made = TreeJoin(left, right, left_key, right_key, columns(left_id, left_value), columns(right_id, right_value), **bounds)
    got = made.partners()
    return got.select(
        F.when(F.col("is_left"), sides[0]).otherwise(sides[1]).alias("side"), "id", F.col("key").cast("long").alias("client_id"), "copies",
        F.col("met").alias("inner_rows"), F.when(F.col("is_left"), F.col("outer")).otherwise(F.col("met")).alias("left_rows"),
        F.col("outer").alias("full_rows"), F.col("total").alias("partner_crc"),
    )


def _dealt(id_: str) -> Column:
    """The key as joined: three of ten ids, by the CRC-32 of their digits, go to one of seven hot keys."""
    h = F.crc32(F.col(id_).cast("string").cast("binary"))
    return F.when(h % 10 < 3, F.floor(h / 10).cast("long") % 7).otherwise(F.col("client_id").cast("long"))


def op13_hot_key_join(spark, sf_dir):
    clicks, sales = read(spark, sf_dir, "clicks"), read(spark, sf_dir, "sales")
    return join_report(clicks, sales, "click_id", _dealt("click_id"), "value", "sale_id", _dealt("sale_id"), "total", ("click", "sale"))


_CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def _crc(text: str) -> str:
    """SQL for the CRC-32 of an ASCII text; ``crc_table`` has to be in scope."""
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295)"


SQL = f"""
WITH {_CRC_TABLE},
rows_ AS (
  SELECT 'click' AS side, click_id AS id, client_id, value AS x FROM clicks
  UNION ALL SELECT 'sale', sale_id, client_id, total FROM sales),
crcs AS (
  SELECT side, id, client_id, {_crc("id::VARCHAR")} AS h,
         {_crc("coalesce(id::VARCHAR, '') || ':' || coalesce(CAST(floor(100 * x + 0.5) AS BIGINT)::VARCHAR, '')")} AS crc
  FROM rows_, crc_table),
keyed AS (SELECT side, id, CASE WHEN h % 10 < 3 THEN (h // 10) % 7 ELSE client_id END AS client_id, crc FROM crcs),
sums AS (SELECT side, client_id, count(*) AS n, sum(crc) AS total FROM keyed WHERE client_id IS NOT NULL GROUP BY 1, 2),
met AS (
  SELECT k.side, k.id, k.client_id, coalesce(s.n, 0) AS n, coalesce(s.total, 0) AS total
  FROM keyed k LEFT JOIN sums s ON s.client_id = k.client_id AND s.side <> k.side)
SELECT side, id, max(client_id) AS client_id, count(*) AS copies, CAST(sum(n) AS BIGINT) AS inner_rows,
       CAST(sum(CASE WHEN side = 'click' THEN greatest(n, 1) ELSE n END) AS BIGINT) AS left_rows,
       CAST(sum(greatest(n, 1)) AS BIGINT) AS full_rows, CAST(sum(total) AS BIGINT) AS partner_crc
FROM met GROUP BY side, id
"""
