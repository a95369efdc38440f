"""A knowledge graph derived from star-schema tables (customers, suppliers, parts, orders, events)."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom import schema as S
from graphloom.graph import Graph

# Id layout. Entity id = kind * 10^9 + key, relation id = rkind * 10^18 + src key * 10^9 + tgt key.
KIND = 10**9
RKIND = 10**18
REGION, NATION, SEGMENT, BRAND, SUPPLIER, PART, CUSTOMER, MONTH = range(1, 9)
CREATED = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entity(df, kind, key, name, category, attributes):
    return df.select(
        (F.lit(kind * KIND) + key.cast("long")).alias("id"),
        name.alias("name"),
        F.lit(category).alias("category"),
        attributes.alias("attributes"),
        F.lit(CREATED).cast("timestamp").alias("created_at"),
        F.lit("手工").alias("source"),
    )


def segments(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    return names.select("c_mktsegment", F.dense_rank().over(Window.orderBy("c_mktsegment")).alias("seg_key"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    none = F.lit("{}")
    brand_no = F.substring_index("p_brand", "#", -1)
    month = F.date_format("o_orderdate", "yyyyMM")
    parts = [
        _entity(t("region"), REGION, F.col("r_regionkey"), F.col("r_name"), "物理实体", none),
        _entity(t("nation"), NATION, F.col("n_nationkey"), F.col("n_name"), "物理实体", none),
        _entity(segments(spark, sf_dir), SEGMENT, F.col("seg_key"), F.col("c_mktsegment"), "抽象实体", none),
        _entity(t("part").select("p_brand").distinct(), BRAND, brand_no, F.col("p_brand"), "抽象实体", none),
        _entity(t("supplier"), SUPPLIER, F.col("s_suppkey"), F.col("s_name"), "物理实体",
                F.concat(F.lit('{"acctbal":'), F.col("s_acctbal").cast("string"), F.lit("}"))),
        _entity(t("part"), PART, F.col("p_partkey"), F.col("p_name"), "物理实体",
                F.concat(F.lit('{"type":"'), F.col("p_type"), F.lit('","size":'), F.col("p_size").cast("string"), F.lit("}"))),
        _entity(t("customer"), CUSTOMER, F.col("c_custkey"), F.col("c_name"), "物理实体",
                F.concat(F.lit('{"segment":"'), F.col("c_mktsegment"), F.lit('"}'))),
        _entity(t("orders").select(month.alias("m")).distinct(), MONTH, F.col("m"), F.col("m"), "时间实体", none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _relation(df, rkind, src_kind, src, tgt_kind, tgt, name, category, confidence=None, ref=None):
    return df.select(
        (F.lit(rkind * RKIND) + src.cast("long") * KIND + tgt.cast("long")).alias("id"),
        (F.lit(src_kind * KIND) + src.cast("long")).alias("source_id"),
        (F.lit(tgt_kind * KIND) + tgt.cast("long")).alias("target_id"),
        F.lit(name).alias("name"),
        F.lit(category).alias("category"),
        (confidence if confidence is not None else F.lit("确证")).alias("confidence"),
        (ref if ref is not None else F.lit("")).alias("source_ref"),
        F.lit(CREATED).cast("timestamp").alias("created_at"),
        F.lit("手工" if ref is None else "文档").alias("source"),
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    line = t("lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_returnflag")
    confidence = F.expr("CASE flag WHEN 'A' THEN '推测' WHEN 'N' THEN '确证' ELSE '存疑' END")
    ref = F.concat(F.lit("order:"), F.col("o").cast("string"))
    aggs = [F.min("l_returnflag").alias("flag"), F.min("l_orderkey").alias("o")]
    supplies = line.groupBy("l_suppkey", "l_partkey").agg(*aggs)
    buys = (
        line.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", "l_partkey").agg(*aggs)
    )
    nation = t("nation")
    beside = nation.withColumn(
        "next", F.lead("n_nationkey").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    ).where("next IS NOT NULL")
    in_segment = t("customer").join(segments(spark, sf_dir), "c_mktsegment")
    c = F.col
    out = [
        _relation(nation, 1, NATION, c("n_nationkey"), REGION, c("n_regionkey"), "位于", "空间"),
        _relation(t("supplier"), 2, SUPPLIER, c("s_suppkey"), NATION, c("s_nationkey"), "位于", "空间"),
        _relation(t("customer"), 3, CUSTOMER, c("c_custkey"), NATION, c("c_nationkey"), "位于", "空间"),
        _relation(in_segment, 4, CUSTOMER, c("c_custkey"), SEGMENT, c("seg_key"), "属于", "归属"),
        _relation(t("part"), 5, BRAND, F.substring_index("p_brand", "#", -1), PART, c("p_partkey"), "创建", "互动"),
        _relation(supplies, 6, SUPPLIER, c("l_suppkey"), PART, c("l_partkey"), "供应", "互动", confidence, ref),
        _relation(buys, 7, CUSTOMER, c("o_custkey"), PART, c("l_partkey"), "购买", "互动", confidence, ref),
        _relation(beside, 8, NATION, c("n_nationkey"), NATION, c("next"), "相邻", "空间"),
    ]
    df = out[0]
    for p in out[1:]:
        df = df.unionByName(p)
    return df


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(
        (F.lit(NATION * KIND) + F.col("n_nationkey").cast("long")).alias("entity_id"),
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("alias"),
    )
    customer = table(spark, sf_dir, "customer").select(
        (F.lit(CUSTOMER * KIND) + F.col("c_custkey").cast("long")).alias("entity_id"),
        F.concat(F.lit("C#"), F.col("c_custkey").cast("string")).alias("alias"),
    )
    return nation.unionByName(customer).select(
        F.col("entity_id").alias("id"), "entity_id", "alias", F.lit(CREATED).cast("timestamp").alias("created_at")
    )


def op_logs(events: DataFrame) -> DataFrame:
    """The event stream seen as a change log; works on a static or a streaming table."""
    uid, eid = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    op = F.expr(
        "CASE event_type WHEN 'signup' THEN 'ADD_ENTITY' WHEN 'purchase' THEN 'ADD_RELATION' "
        "WHEN 'click' THEN 'UPDATE_ENTITY' WHEN 'view' THEN 'ADD_ALIAS' ELSE 'UNDO' END"
    )
    entity = lambda name: F.concat(
        F.lit('{"id":'), uid, F.lit(',"name":"'), name, F.lit('","category":"抽象实体","source":"手工"}'))
    snapshot = (
        F.when(op == "ADD_ENTITY", F.concat(F.lit('{"entity":'), entity(F.concat(F.lit("user "), uid)), F.lit("}")))
        .when(op == "ADD_RELATION", F.concat(
            F.lit('{"relation":{"id":'), eid, F.lit(',"source_id":'), uid,
            F.lit(',"target_id":1000000000,"name":"购买","category":"互动"}}')))
        .when(op == "UPDATE_ENTITY", F.concat(
            F.lit('{"before":'), entity(F.concat(F.lit("user "), uid)),
            F.lit(',"after":'), entity(F.concat(F.lit("user "), uid, F.lit(" e"), eid)), F.lit("}")))
        .when(op == "ADD_ALIAS", F.concat(
            F.lit('{"alias":{"entity_id":'), uid, F.lit(',"alias":"u'), eid, F.lit('"}}')))
        .otherwise(F.concat(F.lit('{"undone_log":'), eid, F.lit("}")))
    )
    return events.select(
        (F.col("event_id") + 1).cast("long").alias("id"), op.alias("op_type"), snapshot.alias("snapshot"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.when(op == "UNDO", F.lit("系统")).otherwise(F.lit("手工")).alias("source"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part vectors; vectors with an odd label carry an outdated text."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat(
        F.col("p_name"), F.lit("（物理实体） type:"), F.col("p_type"), F.lit("；size:"), F.col("p_size").cast("string")
    ).alias("now"))
    emb = table(spark, sf_dir, "embeddings")
    return emb.join(part, emb.vec_id == part.p_partkey, "left").select(
        (F.lit(PART * KIND) + F.col("vec_id")).alias("entity_id"),
        F.when(F.col("label") % 2 == 0, F.coalesce("now", F.lit(""))).otherwise(F.lit("old")).alias("text"),
        F.col("embedding").alias("vector"),
        F.lit(CREATED).cast("timestamp").alias("updated_at"),
    )


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    empty = lambda s: spark.createDataFrame([], s)
    return Graph(
        entities=entities(spark, sf_dir),
        relations=relations(spark, sf_dir),
        aliases=aliases(spark, sf_dir),
        op_logs=op_logs(table(spark, sf_dir, "events")),
        vectors=vectors(spark, sf_dir),
        entity_images=images(spark, sf_dir),
        relation_images=empty(S.RELATION_IMAGES),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image rows of suppliers, taken from the raw pages: one page is one stored file."""
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("long").alias("id"),
        (F.lit(SUPPLIER * KIND) + F.col("page_id") % 10).alias("entity_id"),
        F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("filename"),
        F.col("url").alias("stored_path"), F.lit("").alias("thumb_path"), F.lit("").alias("caption"),
        F.lit(CREATED).cast("timestamp").alias("created_at"),
    )
