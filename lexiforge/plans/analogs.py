"""Driver tables re-cast as the relations the operators expect.

The driver data has no card catalogue, so each card relation is derived from
a TPC-H-like table (every derivation is a narrow projection, so the work
grows with the table):

  printings   <- part        uuid = p_partkey, name = p_name (some split
                             names built with p_brand / p_type), coded
                             attributes derived from p_size
  legalities  <- lineitem    (l_partkey, 'Legal' when l_returnflag = 'R')
  rulings     <- lineitem    one line of text per lineitem of the part
  combos      <- orders + lineitem + part, nested per order
  rules QA    <- supplier x nation, customer (static question/answer tables)
  documents / queries / vectors / conversations are used as they are.

``oracle_sql`` in ``lexiforge.plans.oracle`` derives the same relations in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.operators.canonical import attach_rulings, legal_keys, representatives, typed_cards
from lexiforge.operators.nest import ComboTables, shred_variants
from lexiforge.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _bits(size: Column) -> Column:
    """Colour list from bits of ``size``, in reverse colour order (``U, W``),
    empty when no bit is set, null for every 16th size."""
    parts = [F.when(size.bitwiseAND(b) != 0, F.lit(c))
             for b, c in ((16, "G"), (8, "R"), (4, "B"), (2, "U"), (1, "W"))]
    return F.when(size % 16 == 0, F.lit(None).cast("string")).otherwise(F.concat_ws(", ", *parts))


def printings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    size, name, ptype = F.col("p_size"), F.col("p_name"), F.col("p_type")
    s = lambda x: x.cast("string")
    return p.select(
        F.col("p_partkey").alias("uuid"),
        F.when(size % 10 == 0, F.concat(name, F.lit(" // "), F.col("p_brand")))
         .when(size % 10 == 5, F.concat(name, F.lit("//"), ptype))
         .otherwise(name).alias("name"),
        F.when(size % 3 == 0, F.lit("a")).when(size % 3 == 1, F.lit("b")).alias("side"),
        F.when(size % 4 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("{"), s(size % 7), F.lit("}{"),
                             F.substring(F.lit("WUBRG"), (size % 5 + 1).cast("int"), 1),
                             F.lit("}"))).alias("manaCost"),
        F.when(size % 9 == 0, s(size.cast("double") + 0.5))
         .otherwise(s(size.cast("double"))).alias("manaValue"),
        F.when(size % 6 == 0, F.concat(F.lit("Basic Land — "), ptype))
         .when(size % 6 == 1, F.concat(F.lit("Island "), ptype))
         .otherwise(F.concat(F.lit("Creature — "), ptype)).alias("type"),
        F.when(size % 8 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Deal "), s(size), F.lit(" damage to any "),
                             F.lower(ptype), F.lit(" target."))).alias("text"),
        F.when(size % 5 == 0, F.lit(None).cast("string")).when(size % 5 == 1, F.lit("*"))
         .otherwise(s(size % 7)).alias("power"),
        F.when(size % 7 == 0, F.lit(None).cast("string")).otherwise(s(size % 4)).alias("toughness"),
        F.when(size % 11 == 0, s(size % 6)).alias("loyalty"),
        _bits(size).alias("colors"),
        F.when(size % 13 == 0, F.lit(None).cast("string")).otherwise(_bits(size)).alias("colorIdentity"),
        F.when(size % 2 == 0, F.concat(F.lit("Flying, "), F.lower(ptype))).alias("keywords"),
        F.when(size % 12 == 0, F.upper(name)).alias("asciiName"),
        F.when(size % 4 == 0, F.lit("common")).when(size % 4 == 1, F.lit("uncommon"))
         .when(size % 4 == 2, F.lit("rare")).otherwise(F.lit("")).alias("rarity"),
        F.when(size % 5 == 0, F.lit("split")).otherwise(F.lit("normal")).alias("layout"),
    )


def legalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("uuid"),
                     F.when(F.col("l_returnflag") == "R", F.lit("Legal"))
                      .otherwise(F.lit("Banned")).alias("modern"))


def rulings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("uuid"),
                     F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"),
                              F.lit(" line "), F.col("l_linenumber").cast("string"),
                              F.lit(" ships "), F.col("l_linestatus")).alias("text"))


CANONICAL_OUT = ["uuid", "name", "side", "manaCost", "manaValue", "type", "power",
                 "toughness", "loyalty", "colors", "colorIdentity", "keywords",
                 "asciiName", "rarity", "layout", "text", "rulings"]


def canonical(spark: SparkSession, sf_dir: str, with_rulings: bool = True) -> DataFrame:
    """Canonical rows. Representatives are ranked once: those that get rulings
    are written (the filtered-cards sink, S-3) and read back for both joins."""
    pr = printings(spark, sf_dir)
    reps = representatives(pr, legal_keys(legalities(spark, sf_dir)))
    if not with_rulings:
        return reps
    return attach_rulings(materialize(reps, "representatives"), rulings(spark, sf_dir))


def cards(spark: SparkSession, sf_dir: str, compat: bool = False, persist: bool = False,
          with_rulings: bool = True) -> DataFrame:
    """Canonical, typed card relation. With ``persist`` the canonical rows are
    written once and read back typed (S-4), for queries with several branches;
    queries that read no rulings leave them out."""
    rows = canonical(spark, sf_dir, with_rulings)
    if persist:
        rows = materialize(rows, "cards")
    return typed_cards(rows, compat=compat)


# --- combos ------------------------------------------------------------------

def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested variant row per order (the shape of the combo JSON).

    Orders and lines share one grouping, so no join sorts the grouped lines. The
    nested use / require / produce structs are zipped per order from the fields of
    its lines: that compiles, where a ``transform`` to structs is interpreted.
    """
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem").where(F.col("l_orderkey").isNotNull())
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    # line order: (linenumber, partkey, suppkey, quantity, price) is a total order
    lines = li.join(p, li.l_partkey == p.p_partkey, "inner").select(
        F.col("l_orderkey").alias("o_orderkey"), F.struct(
            F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("pk"),
            F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("qty"),
            F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"),
            F.col("l_linestatus").alias("status"), F.col("p_name").alias("pname"),
            F.col("p_type").alias("ptype")).alias("l"))
    heads = o.where(F.col("o_orderkey").isNotNull()).select(
        "o_orderkey", F.struct("o_orderpriority", "o_orderstatus").alias("o"))
    # collect_list reduces nothing map-side, so hash the rows by order first:
    # same shuffle volume, and the lists are built in parallel reduce tasks.
    rows = heads.unionByName(lines, allowMissingColumns=True).repartition("o_orderkey")
    v = (rows.groupBy("o_orderkey")
         .agg(F.collect_list("o").alias("os"), F.sort_array(F.collect_list("l")).alias("ls"))
         .select("o_orderkey", F.explode("os").alias("o"), "ls").select("o_orderkey", "o.*", "ls"))
    # orders without a key have no lines and pass beside the grouping, not as one group
    v = v.unionByName(o.where(F.col("o_orderkey").isNull()).select(
        "o_orderkey", "o_orderpriority", "o_orderstatus", F.array().cast(v.schema["ls"].dataType).alias("ls")))
    v = v.withColumn("rs", F.filter("ls", lambda x: x["status"] == "O"))
    zones = F.transform("ls.flag", lambda x: F.when(x == "R", F.array(F.lit("B")))
                        .when(x == "A", F.array(F.lit("G"), F.lit("E"))).otherwise(F.array(F.lit("H"))))
    feature = F.transform("ls.n", lambda n: F.when(n % 3 == 0, F.lit("Infinite ETB"))
                          .when(n % 3 == 1, F.lit("Infinite LTB")).otherwise(F.lit("ETB then LTB")))
    steps = F.transform("ls", lambda x: F.concat(F.lit("Use "), x["pname"], F.lit(" x"), x["qty"].cast("int").cast("string")))

    def zipped(fields: dict[str, Column]) -> Column:
        """Arrays of one value a line as one array of structs."""
        return F.arrays_zip(*[c.alias(name) for name, c in fields.items()])

    def every(lines: str, value: Column) -> Column:
        return F.array_repeat(value, F.size(lines))

    none = F.lit(None).cast("string")
    states = lambda lines, *names: {f"{x}CardState": every(lines, none) for x in names}
    uses = zipped({
        "card": zipped({"oracleId": F.col("ls.pk").cast("array<string>"), "name": F.col("ls.pname")}),
        "zoneLocations": zones, "battlefieldCardState": every("ls", F.lit("tapped")),
        **states("ls", "exile", "library"),
        "mustBeCommander": F.transform("ls.n", lambda n: n == 1), "quantity": F.col("ls.qty").cast("array<int>")})
    requires = zipped({
        "template": zipped({"id": F.col("rs.n").cast("array<bigint>"),
                            "name": F.transform("rs.ptype", lambda x: F.concat(F.lit("Any "), x))}),
        "zoneLocations": every("rs", F.array(F.lit("B"))),
        **states("rs", "battlefield", "exile", "library", "graveyard"),
        "mustBeCommander": every("rs", F.lit(False)), "quantity": every("rs", F.lit(1))})
    produces = zipped({
        "feature": zipped({"id": F.col("ls.n").cast("array<bigint>"), "name": feature,
                           "uncountable": F.transform("ls.n", lambda n: n % 2 == 0)}),
        "quantity": F.col("ls.qty").cast("array<int>")})

    return v.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderpriority").alias("manaNeeded"),
        F.size("ls").alias("manaValueNeeded"),
        F.col("o_orderstatus").alias("identity"),
        F.size("ls").alias("variantCount"),
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("Keep priority "), F.col("o_orderpriority")))
         .when(F.col("o_orderstatus") == "P",
               F.concat(F.lit("Hold two mana open\nPriority "), F.col("o_orderpriority")))
         .alias("otherPrerequisites"),
        F.when(F.size("ls") > 0, F.array_join(steps, "\n")).alias("description"),
        F.lit("").alias("notes"),
        zipped({"id": F.col("ls.supp")}).alias("of"),
        zipped({"id": F.col("ls.pk")}).alias("includes"),
        uses.alias("uses"),
        requires.alias("requires"),
        produces.alias("produces"),
    )


def combo_tables(spark: SparkSession, sf_dir: str) -> ComboTables:
    """The nested source feeds four branches: land it once (S-2), then shred."""
    return shred_variants(materialize(variants(spark, sf_dir), "variants"))


# --- rules (static QA tables) ------------------------------------------------

def rule_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer")
    supplier_nation = s.join(n, s.s_nationkey == n.n_nationkey, "inner").select(
        F.concat(F.lit("Which nation is "), F.col("s_name"), F.lit(" based in?")).alias("question"),
        F.col("n_name").alias("answer"))
    segments = c.select(
        F.concat(F.lit("What market segment is "), F.col("c_name"), F.lit(" in?")).alias("question"),
        F.col("c_mktsegment").alias("answer"))
    return {"supplier_nation": supplier_nation, "customer_segment": segments}


# --- retrieval inputs ----------------------------------------------------------

def doc_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> (id, content, meta, lang, source, n_chars)."""
    d = table(spark, sf_dir, "documents")
    e = F.lit("")
    meta = F.struct(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"),
                    F.col("source").alias("mana_cost"), F.col("n_chars").cast("double").alias("cmc"),
                    F.col("lang").alias("color_identity"), e.alias("type"), e.alias("power"),
                    e.alias("toughness"), e.alias("rarity"), e.alias("loyalty"), e.alias("side"))
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), meta.alias("meta"),
                    "lang", "source", "n_chars")


def query_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as queries, with the embedding of the same id."""
    b = table(spark, sf_dir, "benchmark")
    e = table(spark, sf_dir, "embeddings")
    return (b.join(e, b.item_id == e.vec_id, "left")
            .select(F.col("item_id").alias("query_id"), "text", "embedding"))


def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as (id, embedding)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def doc_vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of documents: a hybrid result names a document."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return vector_table(spark, sf_dir).join(d, "id", "left_semi")
