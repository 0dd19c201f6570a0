"""One large JSON document read by many tasks: the objects of its root's arrays as rows.

Spark splits text at any separator, so a document is read in pieces that end
with a closing brace, its blocks in parallel. What a piece means depends on what
stands before it: whether it begins within a string, and how many braces and
brackets are open. Both are prefix sums: quotes by their parity, then braces and
brackets. They are taken in two steps, sums of blocks first (a few rows a file),
then places within a block, so no task sees more than a block. An element of an
array of the root ends where one brace and one bracket are left open; pieces
between two ends are one element.

A text of a pack lies in one row, so it is one block: its sums are windows over
its pieces, all by one exchange, and nothing is joined back to them.

A document that ends early, or goes on after its root, has an error and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlake.operators.tables import kept

STRING = r'"(?:[^"\\]|\\.)*+"'
#: Where an array of the root begins.
OPENING = r'"([^"\\]+)"\s*:\s*\[\s*$'


def _count(text: Column, char: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(char), F.lit("")))


def few(source):
    """How to join a row a file or block: as a broadcast for files, of which there are few large ones; as Spark sees fit for a pack, which may hold any number."""
    return (lambda df: df) if isinstance(source, DataFrame) else F.broadcast


def _before(rows: DataFrame, value: str, name: str, pack: bool = False) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over all earlier pieces of the file, by sums of blocks and places in the block."""
    if pack:
        return rows.withColumn(name, F.sum(value).over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) - F.col(value))
    blocks = rows.groupBy("path", "block").agg(F.sum(value).alias("whole"))
    earlier = F.sum("whole").over(Window.partitionBy("path").orderBy("block")) - F.col("whole")
    starts = blocks.select("path", "block", earlier.alias("start"))
    inside = F.sum(value).over(Window.partitionBy("path", "block").orderBy("at")) - F.col(value)
    return rows.withColumn("inside", inside).join(F.broadcast(starts), ["path", "block"]).withColumn(name, F.col("start") + F.col("inside")).drop("start", "inside")  # a row a block


def _texts(spark: SparkSession, paths: str | list[str] | DataFrame) -> DataFrame:
    """(path, block, at, s, closed): the texts between closing braces, of files or of a pack (path, text); ``closed``: one follows."""
    if isinstance(paths, DataFrame):
        text = F.regexp_replace("text", "^\ufeff", "")
        parts = F.when(F.length(text) > 0, F.split(F.regexp_replace(text, r"\}\z", ""), r"\}"))
        rows = paths.select("path", text.endswith("}").alias("whole"), F.size(parts).alias("n"), F.posexplode(parts).alias("at", "s"))
        return rows.select("path", F.lit(0).cast("bigint").alias("block"), F.col("at").cast("bigint").alias("at"), "s", (F.col("whole") | (F.col("at") < F.col("n") - 1)).alias("closed"))
    read, meta = spark.read.option("lineSep", "}").text(paths), F.col("_metadata")
    rows = read.select(meta["file_path"].alias("path"), meta["file_size"].alias("size"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("s"))
    # The last piece lacks its brace if the pieces' bytes, with a brace each, are one more than the file's (a mark of three bytes at its start is not read).
    ends = rows.groupBy("path").agg(F.max(F.struct("block", "at")).alias("last"), F.sum(F.octet_length("s") + 1).alias("bytes"), F.max("size").alias("size"))
    rows = rows.join(F.broadcast(ends.select("path", "last", (F.col("size") - F.col("bytes")).isin(0, 3).alias("whole"))), "path")
    return rows.withColumn("closed", F.col("whole") | (F.struct("block", "at") != F.col("last"))).drop("whole", "last", "size")


def pieces(spark: SparkSession, paths: str | list[str] | DataFrame) -> DataFrame:
    """(path, block, at, s, closed, in_string, braces, brackets): texts up to a closing brace (``closed``: it stands there), with what is open before them."""
    pack = isinstance(paths, DataFrame)
    bare = F.regexp_replace("s", r"(?s)\\.", "")  # no escape is cut by a brace
    outside = lambda text: F.regexp_replace(text, r'"[^"]*+(?:"|\z)', " ")
    # What is no string's, if the piece begins outside of one, and if it begins within one.
    parts = _texts(spark, paths).withColumn("bare", bare).withColumn("quotes", _count(F.col("bare"), '"')).withColumn("same", outside(F.col("bare"))).withColumn("other", outside(F.concat(F.lit('"'), "bare")))
    counts = {f"{side}_{name}": _count(F.col(side), char) for side in ("same", "other") for name, char in (("open", "{"), ("from", "["), ("to", "]"))}
    parts = _before(parts.withColumns(counts).drop("bare", "same", "other"), "quotes", "quoted", pack)
    parts = parts.withColumn("in_string", F.col("quoted") % 2 == 1)
    plain = lambda name: F.when(F.col("in_string"), F.col(f"other_{name}")).otherwise(F.col(f"same_{name}"))
    real = F.col("closed") & ((F.col("quoted") + F.col("quotes")) % 2 == 0)  # the brace is none of a string's
    deep = parts.withColumn("real", real).withColumn("more_braces", plain("open") - F.col("real").cast("int")).withColumn("more_brackets", plain("from") - plain("to"))
    deep = deep.drop("quoted", "quotes", *counts)
    return _before(_before(deep, "more_braces", "braces", pack), "more_brackets", "brackets", pack)


def _error(braces: Column, brackets: Column, over: Column, last: Column) -> Column:
    """What is wrong with a document: of what is left open, where its root is closed first, and its last piece that is not blank."""
    return F.when((braces != 0) | (brackets != 0), "JSON ends early").when(F.coalesce(over < last, F.lit(False)), "JSON goes on after its root")


def _joined(pieces: Column) -> Column:
    """The text of an element from its pieces (at first, ``s`` with its brace, ``opens``) in any order."""
    ps = F.array_sort(pieces)
    begins = F.coalesce(F.array_max(F.transform(ps, lambda p, k: F.when(p["opens"], k))), F.lit(0))
    return F.regexp_replace(F.array_join(F.transform(F.slice(ps, begins + 1, F.size(ps)), lambda p: p["s"]), ""), r"^[\s,]+", "")


def elements(spark: SparkSession, paths: str | list[str] | DataFrame) -> DataFrame:
    """(path, error, section, position, element, head): the objects of each array of the root, as JSON text, by the array's name and their place in it.

    ``head`` is, in the row of an array's first object only, what stands before the array, closed so that it can be read. A
    file with an error is one row without an element.
    """
    pack = isinstance(paths, DataFrame)
    rows = pieces(spark, paths)
    after_braces, after_brackets = F.col("braces") + F.col("more_braces"), F.col("brackets") + F.col("more_brackets")
    rows = rows.withColumn("ends", (F.col("real") & (after_braces == 1) & (after_brackets == 1)).cast("int"))
    # An array of the root begins with the first bracket before a brace, if only the root's brace is open there.
    whole = F.concat(F.when(F.col("in_string"), '"').otherwise(""), "s")
    found = F.regexp_extract(whole, rf'(?s)^((?:[^"\[]|{STRING}|\[(?!\s*\{{))*+\[)\s*\{{', 1)
    outside = F.regexp_replace(found, STRING, "")
    depth, lists = F.col("braces") + _count(outside, "{"), F.col("brackets") + _count(outside, "[") - _count(outside, "]")
    opening = F.when(F.col("s").contains("[") & (F.col("braces") <= 1) & (depth == 1) & (lists == 1), F.substr(found, F.when(F.col("in_string"), 2).otherwise(1)))
    rows = _before(rows.withColumn("opening", opening), "ends", "nth", pack).withColumn("opens", F.length("opening") > 0)
    rows = rows.withColumns({"over": F.when(after_braces <= 0, F.struct("block", "at")), "said": F.when(F.col("s").rlike(r"\S"), F.struct("block", "at"))})
    return _of_pack(rows) if pack else _of_files(rows)


def _of_pack(rows: DataFrame) -> DataFrame:
    """The elements of texts, each of whose pieces goes to its element and to the heads of the arrays that it stands before."""
    text = Window.partitionBy("path")
    error = _error(F.sum("more_braces").over(text), F.sum("more_brackets").over(text), F.min("over").over(text), F.max("said").over(text))
    array = F.struct("at", F.col("nth").alias("first"), F.regexp_extract("opening", OPENING, 1).alias("name"))
    rows = rows.select("path", "at", "nth", "s", "ends", "opening", "opens", error.alias("error"), F.array_sort(F.collect_list(F.when(F.col("opens"), array)).over(text)).alias("arrays"))
    rows = rows.filter(F.when(F.col("error").isNull(), F.size("arrays") > 0).otherwise(F.col("at") == 0))
    own = F.struct("nth", F.lit(False).alias("head"), F.col("opens").alias("cut"))
    heads = F.transform(F.filter("arrays", lambda a: F.col("error").isNull() & (a["at"] >= F.col("at"))), lambda a: F.struct(a["first"].alias("nth"), F.lit(True).alias("head"), (a["at"] == F.col("at")).alias("cut")))
    rows = rows.withColumn("to", F.explode(F.concat(F.array(own), heads)))
    piece = F.when(F.col("to.head") & F.col("to.cut"), F.concat("opening", F.lit("]}"))).when(F.col("to.cut"), F.concat(F.substr("s", F.length("opening") + 1), F.lit("}"))).otherwise(F.concat("s", F.lit("}")))
    rows = rows.select("path", F.col("to.nth").alias("nth"), F.col("to.head").alias("of_head"), "at", piece.alias("s"), "opens", "ends", "error", "arrays")
    grouped = rows.groupBy("path", "nth").agg(
        F.first("error").alias("error"), F.first("arrays").alias("arrays"), F.max(F.when(~F.col("of_head"), F.col("ends"))).alias("ended"),
        F.collect_list(F.when(~F.col("of_head"), F.struct("at", "s", "opens"))).alias("ps"), F.collect_list(F.when(F.col("of_head"), F.struct("at", "s"))).alias("hs"),
    )
    good = F.col("error").isNull()
    array = F.try_element_at(F.filter("arrays", lambda x: x["first"] <= F.col("nth")), F.lit(-1))
    head = F.when(F.size("hs") > 0, F.array_join(F.transform(F.array_sort("hs"), lambda x: x["s"]), ""))
    return grouped.filter("ended = 1 or error is not null").select("path", "error", F.when(good, array["name"]).alias("section"), F.when(good, F.col("nth") - array["first"]).alias("position"), F.when(good, _joined(F.col("ps"))).alias("element"), F.when(good, head).alias("head"))


def _of_files(rows: DataFrame) -> DataFrame:
    """The elements of files, of which there are few."""
    join = F.broadcast
    rows = kept(rows, "json-pieces")  # several steps read it
    total = rows.groupBy("path").agg(F.sum("more_braces").alias("b"), F.sum("more_brackets").alias("k"), F.min("over").alias("over"), F.max("said").alias("last"))
    states = total.select("path", _error(F.col("b"), F.col("k"), F.col("over"), F.col("last")).alias("error"))
    starts = rows.filter("opens").select("path", "nth", F.struct("block", "at").alias("place"), "opening")
    sections = starts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(F.col("nth").alias("first"), F.regexp_extract(F.col("opening"), OPENING, 1).alias("name")))).alias("sections"))  # the root's arrays
    before = rows.drop("opening").join(join(starts.select("path", F.col("place").alias("to"), F.col("nth").alias("first"), "opening")), "path").filter(F.struct("block", "at") < F.col("to"))
    heads = before.groupBy("path", "first", "opening").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", F.concat("s", F.lit("}")).alias("s")))), lambda x: x["s"]), "").alias("text"))
    heads = starts.select("path", F.col("nth").alias("first"), "opening").join(heads, ["path", "first", "opening"], "left").select("path", F.col("first").alias("nth"), F.concat(F.coalesce("text", F.lit("")), "opening", F.lit("]}")).alias("head"))
    own = F.concat(F.when(F.col("opens"), F.substr("s", F.length("opening") + 1)).otherwise(F.col("s")), F.lit("}"))
    ended = rows.groupBy("path", "nth").agg(F.max("ends").alias("ended"), F.collect_list(F.struct("block", "at", own.alias("s"), "opens")).alias("ps")).filter("ended = 1")
    found = ended.select("path", "nth", _joined(F.col("ps")).alias("element")).join(join(sections), "path")
    own = F.try_element_at(F.filter("sections", lambda x: x["first"] <= F.col("nth")), F.lit(-1))
    found = found.select("path", "nth", own["name"].alias("section"), (F.col("nth") - own["first"]).alias("position"), "element").join(heads, ["path", "nth"], "left").drop("nth")
    good = found.join(join(states), "path").filter("error is null").select("path", "error", "section", "position", "element", "head")
    return good.unionByName(states.filter("error is not null"), allowMissingColumns=True)
