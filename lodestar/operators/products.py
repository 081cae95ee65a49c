"""The product catalog: clean rows, searchable fields, and search over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import retrieval
from .options import _PLAIN, _WIDE

#: Fields of the index and their weights; price of a product without one.
WEIGHTS = {"title": 3.0, "brand": 2.0, "category": 2.0, "model": 2.5, "attributes": 1.5, "options": 1.2, "bullets": 0.8}
DEFAULT_PRICE = 100.0
MODEL = r"(?<![a-z0-9])(?=[a-z0-9._+\-/]*[a-z])(?=[a-z0-9._+\-/]*[0-9])([a-z0-9]+(?:[._+\-/][a-z0-9]+)*)"


def clean(raw: DataFrame) -> DataFrame:
    """SRC8: rows by their place in the source (``task_id``), without unusable ids; the first row of an
    id stays; option axes and values in lower case, a slash as a bar; a default price."""
    usable = raw.filter(F.col("asin").isNotNull() & (F.col("asin") != "nan") & (F.length("asin") <= 20))
    first = usable.groupBy("asin").agg(F.min("task_id").alias("task_id"))
    rows = usable.join(first, ["asin", "task_id"], "left_semi")
    plain = lambda c: F.trim(F.replace(F.lower(c), F.lit("/"), F.lit(" | ")))
    axes = F.transform_keys("customization_options", lambda k, v: plain(k))
    options = F.transform_values(axes, lambda k, vs: F.transform(vs, lambda v: v.withField("value", plain(v["value"]))))
    price = F.when(F.size(F.coalesce("pricing", F.array().cast("array<double>"))) > 0, F.slice("pricing", 1, 2)).otherwise(F.array(F.lit(DEFAULT_PRICE)))
    return rows.withColumn("customization_options", options).withColumn("pricing", price)


def _or(*columns: str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit(""))


def option_words(options: Column) -> Column:
    """RET5: axes in order, each with its available values and their prices."""
    entries = F.array_sort(F.map_entries(options))
    shown = lambda v: F.array_compact(F.array(F.nullif(v["value"], F.lit("")), v["price"].cast("string")))
    free = lambda vs: F.filter(vs, lambda v: ~F.coalesce(~v["is_available"], F.lit(False)))
    return F.flatten(F.transform(entries, lambda e: F.concat(F.array(e["key"]), F.flatten(F.transform(free(e["value"]), shown)))))


def fields(products: DataFrame) -> DataFrame:
    """RET3: (asin, one text a field of the index)."""
    listed = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ")
    rows = products.select(
        "asin", _or("title").alias("title"), _or("brand", "shop_name").alias("brand"), _or("category").alias("category"), text.normalize_query("title").alias("__t"),
        listed("attribute").alias("attributes"), F.array_join(F.coalesce(option_words(F.col("customization_options")), F.array().cast("array<string>")), " ").alias("options"), listed("small_description").alias("bullets"),
    )
    return rows.withColumn("model", F.array_join(F.array_distinct(F.regexp_extract_all("__t", F.lit(MODEL), F.lit(1))), " ")).drop("__t")


def index(products: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """IDX1: postings over the seven weighted fields."""
    weights = WEIGHTS if weights is None else weights
    if set(weights) != set(WEIGHTS) or any(not w > 0 for w in weights.values()):
        raise ValueError("each field needs a positive weight")  # RET8
    rows = fields(products)
    shown = rows.select("asin", *[text.normalize_query(f).alias(f) for f in weights])
    return retrieval.postings(shown, "asin", {f: (text.tokens(F.col(f)), w) for f, w in weights.items()})


def search(products: DataFrame, postings: DataFrame, query: str, k: int = 150) -> DataFrame:
    """RET9: ``<c>`` a category, ``<q>`` a stored query, ``<r>`` at random, else BM25; ranked products."""
    kind, _, rest = query.partition(" ") if query[:3] in ("<c>", "<q>", "<r>") else ("", "", query)
    if kind == "<r>":
        return products.orderBy(F.rand(0)).limit(k)
    if kind:
        return products.filter(F.lower("category" if kind == "<c>" else "query") == rest.strip().lower())
    spark = products.sparkSession
    terms = spark.range(1).select(F.lit(0).alias("query"), F.explode(text.tokens(F.lit(text.query_form(query)))).alias("term"))
    ranked = retrieval.top_k(retrieval.bm25_scores(postings, terms), k).select(F.col("id").alias("asin"), "score", "rank")
    return products.join(F.broadcast(ranked), "asin").orderBy("rank")  # at most k rows


def plain(c: Column, space: str = "") -> Column:
    """STR1 within expressions: full-width characters as ASCII, lower case, white space dropped (or one ``space``)."""
    return F.trim(F.regexp_replace(F.lower(F.translate(c, _WIDE, _PLAIN)), "[\\s\u00a0\u3000]+", space))


def _alias_table(aliases: dict[str, str]):
    """A name's canonical form: itself if no alias."""
    if not aliases:
        return lambda c: c
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return lambda c: F.coalesce(F.try_element_at(table, c), c)


def flat_aliases(listed: dict[str, list[str]]) -> dict[str, str]:
    """MAP1: alias -> canonical name, the canonical one included, all without case and spaces."""
    form = lambda t: "".join(text.fold(t).split())
    return {form(a): form(name) for name, others in listed.items() for a in (name, *others)}


def brand_verdict(required: Column, brand: Column, shop: Column, aliases: dict[str, str]) -> Column:
    """SC1: equal after aliases; the shop counts only where no brand is given."""
    known = _alias_table(aliases)
    have, want = plain(F.coalesce(F.nullif(brand, F.lit("")), shop)), plain(required)
    unknown = (F.coalesce(have, F.lit("")) == "") | (F.coalesce(want, F.lit("")) == "")
    return F.when(unknown, "unverifiable").when(known(have) == known(want), "pass").otherwise("fail")


#: Words before a name that say what a product goes with, not what it is.
GOES_WITH = ("适用", "适配", "兼容", "用于", "可用", "替代")


def brand_evidence(expected: Column, brand: Column, shop: Column, title: Column, attributes: Column, aliases: dict[str, str]) -> Column:
    """SC5: any alias of the brand in brand or shop, in the title (not after a word of ``GOES_WITH``), or as
    a whole attribute."""
    want = plain(expected)
    names = F.array(want)
    if aliases:
        known = _alias_table(aliases)
        pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(c).alias("c")) for a, c in aliases.items()])
        names = F.array_distinct(F.concat(F.transform(F.filter(pairs, lambda p: (p["c"] == known(want)) & (F.length(p["a"]) >= 2)), lambda p: p["a"]), names))
    names = F.filter(names, lambda n: n != "")
    structured, heading = plain(F.concat_ws(" ", brand, shop)), plain(F.coalesce(title, F.lit("")))
    own = F.regexp_replace(heading, f"({'|'.join(GOES_WITH)})", "\u0001")
    # an alias counts where the mark of a compatibility word does not stand right before it
    bare = lambda n: F.length(F.replace(own, n, F.lit(""))) < F.length(F.replace(own, F.concat(F.lit("\u0001"), n), F.lit("\u0001")))
    listed = F.coalesce(F.transform(attributes, plain), F.array().cast("array<string>"))
    return F.when(F.exists(names, lambda n: F.contains(structured, n) | bare(n) | F.array_contains(listed, n)), "pass").otherwise("fail")


def model_verdict(required: Column, model: Column, title: Column) -> Column:
    """SC2: the required model stands in the model (the title if there is none) with no letter or digit right
    before or after it; a model with other characters must be equal."""
    need, hay = plain(required, " "), plain(F.coalesce(F.nullif(model, F.lit("")), title), " ")
    bounded = F.regexp_like(hay, F.concat(F.lit("(?<![a-z0-9])\\Q"), need, F.lit("\\E(?![a-z0-9])")))
    unknown = (F.coalesce(need, F.lit("")) == "") | (F.coalesce(hay, F.lit("")) == "")
    return F.when(unknown, "unverifiable").when(F.when(F.regexp_like(need, F.lit("^[a-z0-9._+-]+$")), bounded).otherwise(need == hay), "pass").otherwise("fail")


def range_mismatch(pricing: Column, options: Column) -> Column:
    """FLT12: the listed range is not that of the option prices."""
    prices = F.filter(F.flatten(F.transform(F.map_values(options), lambda vs: F.transform(vs, lambda v: v["price"]))), lambda p: p.isNotNull())
    return (F.size(prices) > 0) & ((F.array_min(pricing) != F.array_min(prices)) | (F.array_max(pricing) != F.array_max(prices)))
