"""Archive-shaped frames over the driver's tables, with the same projections in DuckDB SQL.

The star tables stand in for a message archive: orders are messages, nations
conversations, customers senders, line items attachments, parts media, suppliers
contacts. ``conversations`` is chat text, ``events`` carries JSON payloads and
``documents`` feeds deduplication. Frames are lazy and prune to the columns a
query takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BIG = "bigint"


class Lens:
    """The archive's tables over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def messages(self) -> DataFrame:
        """Orders as messages; day-granular times give many ties."""
        orders, customer = self.raw("orders"), self.raw("customer")
        joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        content = F.concat(F.col("o_orderpriority"), F.lit(" order "), F.col("o_orderkey").cast("string"), F.lit(" by "), F.col("c_name"))
        return joined.select(
            F.col("o_orderkey").cast(BIG).alias("id"),
            F.col("c_nationkey").cast(BIG).alias("conversation_id"),
            F.col("o_custkey").cast(BIG).alias("sender_id"),
            F.when(F.col("o_custkey") % 2 == 0, "qq").otherwise("wechat").alias("platform"),
            F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("timestamp_ms"),
            F.when(F.col("o_orderstatus") == "O", "outgoing").when(F.col("o_orderstatus") == "P", "system").otherwise("incoming").alias("direction"),
            F.lower("o_orderpriority").alias("message_type"),
            content.alias("content"),
            content.alias("search_text"),
            F.col("c_name").alias("sender_name"),
        )

    def conversations(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").cast(BIG).alias("id"),
            F.when(F.col("n_nationkey") % 2 == 0, "qq").otherwise("wechat").alias("platform"),
            F.when(F.col("n_regionkey") == 1, "private").otherwise("group").alias("kind"),
            F.col("n_name").alias("title"),
        )

    def senders(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").cast(BIG).alias("id"),
            F.when(F.col("c_custkey") % 2 == 0, "qq").otherwise("wechat").alias("platform"),
            F.col("c_custkey").cast("string").alias("native_id"),
            F.col("c_name").alias("current_name"),
            (F.col("c_custkey") % 50 == 0).alias("is_self"),
        )

    def sender_aliases(self) -> DataFrame:
        """One alias for each sender, conversation and priority, last seen at the newest order."""
        return self.messages().groupBy("sender_id", "conversation_id", F.col("message_type").alias("alias")).agg(F.max("timestamp_ms").alias("last_seen"), F.min("timestamp_ms").alias("first_seen"))

    def attachments(self) -> DataFrame:
        line = self.raw("lineitem")
        order = Window.partitionBy("l_orderkey").orderBy(*sorted(c for c in line.columns if c != "l_orderkey"))
        return line.withColumn("ordinal", F.row_number().over(order) - 1).select(
            F.col("l_orderkey").cast(BIG).alias("message_id"),
            F.col("ordinal").cast(BIG).alias("ordinal"),
            F.when(F.col("l_linestatus") == "O", "image").otherwise("file").alias("kind"),
            (F.col("l_returnflag") != "N").alias("is_available"),
            F.col("l_partkey").cast(BIG).alias("media_id"),
        )

    def media(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").cast(BIG).alias("id"), F.col("p_size").cast(BIG).alias("size"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))

    def contacts(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").cast(BIG).alias("id"), F.col("s_name").alias("display_name"), F.col("s_nationkey").cast(BIG).alias("touched"))

    def bindings(self) -> DataFrame:
        """The sender of a contact's number belongs to it; every third binding is primary."""
        senders = self.raw("customer").select(F.col("c_custkey").cast(BIG).alias("sender_id"), F.col("c_mktsegment").alias("account_label"))
        return self.contacts().select(F.col("id").alias("contact_id")).join(senders, F.col("contact_id") == F.col("sender_id")).select("contact_id", "sender_id", "account_label", (F.col("sender_id") % 3 == 0).alias("is_primary"))

    def chat(self) -> DataFrame:
        """Chat turns as messages of one conversation each."""
        role = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
        return self.raw("conversations").select(
            (F.col("conv_id") * 100 + F.col("turn")).cast(BIG).alias("id"),
            F.col("conv_id").cast(BIG).alias("conversation_id"),
            (F.col("conv_id") * 3 + role).cast(BIG).alias("sender_id"),
            (F.lit(1704067200000) + F.col("conv_id") * 3600000 + F.col("turn") * 60000).cast(BIG).alias("timestamp_ms"),
            F.when(F.col("role") == "user", "incoming").when(F.col("role") == "assistant", "outgoing").otherwise("system").alias("direction"),
            F.when(F.col("role") == "system", "system").otherwise("text").alias("message_type"),
            F.col("text").alias("content"),
            F.col("role").alias("sender_name"),
        )

    def events(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").cast(BIG).alias("id"),
            F.col("user_id").cast(BIG).alias("sender_id"),
            F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"),
            F.when(F.col("event_type") == "error", "system").when(F.col("event_type") == "purchase", "outgoing").otherwise("incoming").alias("direction"),
            F.col("event_type").alias("message_type"),
            F.col("props").alias("payload"),
        )

    def documents(self) -> DataFrame:
        """Documents as versions: a three-letter native id within a language, the text's digest as payload."""
        return self.raw("documents").select(
            F.col("doc_id").cast(BIG).alias("seq"),
            F.col("lang").alias("conversation_id"),
            F.substring("text", 1, 3).alias("native_id"),
            F.sha2("text", 256).alias("payload_hash"),
        )


#: The same frames for DuckDB.
SQL = {
    "messages": """SELECT o_orderkey::BIGINT AS id, c_nationkey::BIGINT AS conversation_id, o_custkey::BIGINT AS sender_id,
 CASE WHEN o_custkey % 2 = 0 THEN 'qq' ELSE 'wechat' END AS platform, epoch_ms(o_orderdate)::BIGINT AS timestamp_ms,
 CASE o_orderstatus WHEN 'O' THEN 'outgoing' WHEN 'P' THEN 'system' ELSE 'incoming' END AS direction,
 lower(o_orderpriority) AS message_type, o_orderpriority || ' order ' || o_orderkey || ' by ' || c_name AS content,
 o_orderpriority || ' order ' || o_orderkey || ' by ' || c_name AS search_text, c_name AS sender_name
 FROM orders JOIN customer ON o_custkey = c_custkey""",
    "convs": """SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'qq' ELSE 'wechat' END AS platform,
 CASE WHEN n_regionkey = 1 THEN 'private' ELSE 'group' END AS kind, n_name AS title FROM nation""",
    "senders": """SELECT c_custkey::BIGINT AS id, CASE WHEN c_custkey % 2 = 0 THEN 'qq' ELSE 'wechat' END AS platform,
 c_custkey::VARCHAR AS native_id, c_name AS current_name, c_custkey % 50 = 0 AS is_self FROM customer""",
    "sender_aliases": """SELECT sender_id, conversation_id, message_type AS alias, max(timestamp_ms) AS last_seen, min(timestamp_ms) AS first_seen
 FROM messages GROUP BY ALL""",
    "attachments": """SELECT l_orderkey::BIGINT AS message_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_extendedprice,
 l_linenumber, l_linestatus, l_partkey, l_quantity, l_returnflag, l_shipdate, l_suppkey, l_tax) - 1)::BIGINT AS ordinal,
 CASE WHEN l_linestatus = 'O' THEN 'image' ELSE 'file' END AS kind, l_returnflag <> 'N' AS is_available, l_partkey::BIGINT AS media_id FROM lineitem""",
    "media": "SELECT p_partkey::BIGINT AS id, p_size::BIGINT AS size, p_name AS name, p_brand AS brand FROM part",
    "contacts": "SELECT s_suppkey::BIGINT AS id, s_name AS display_name, s_nationkey::BIGINT AS touched FROM supplier",
    "bindings": """SELECT s_suppkey::BIGINT AS contact_id, c_custkey::BIGINT AS sender_id, c_mktsegment AS account_label, c_custkey % 3 = 0 AS is_primary
 FROM supplier JOIN customer ON s_suppkey = c_custkey""",
    "chat": """SELECT (conv_id * 100 + turn)::BIGINT AS id, conv_id::BIGINT AS conversation_id,
 (conv_id * 3 + CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END)::BIGINT AS sender_id,
 (1704067200000 + conv_id * 3600000 + turn * 60000)::BIGINT AS timestamp_ms,
 CASE role WHEN 'user' THEN 'incoming' WHEN 'assistant' THEN 'outgoing' ELSE 'system' END AS direction,
 CASE WHEN role = 'system' THEN 'system' ELSE 'text' END AS message_type, text AS content, role AS sender_name FROM conversations""",
    "evts": """SELECT event_id::BIGINT AS id, user_id::BIGINT AS sender_id, (epoch_us(ts) // 1000)::BIGINT AS timestamp_ms,
 CASE event_type WHEN 'error' THEN 'system' WHEN 'purchase' THEN 'outgoing' ELSE 'incoming' END AS direction,
 event_type AS message_type, props AS payload FROM events""",
    "docs": """SELECT doc_id::BIGINT AS seq, lang AS conversation_id, substring(text, 1, 3) AS native_id, sha256(text) AS payload_hash FROM documents""",
}


def with_lens(query: str, *names: str) -> str:
    """``query`` after the projections it names, in the order given."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + (",\n" if query.lstrip().startswith("+") else "\n") + query.lstrip().lstrip("+")
