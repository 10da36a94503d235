"""Joins of messages with lists of domains, always on distinct domains or names first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailcorpus.functions import columns as C
from mailcorpus.functions import fixed as X


#: Rows of a list that is compared with every distinct host and therefore broadcast.
LIST_MOST = 10_000


def _table(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def _list(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A configured list for a join that is no equality, of a checked size."""
    if len(rows) > LIST_MOST:
        raise ValueError(f"a list of {len(rows)} rows is too long to compare with every host; at most {LIST_MOST}")
    return F.broadcast(_table(df, rows, schema))


def deletions(text: Column, most: int) -> Column:
    """The distinct strings that are left of a text without up to ``most`` of its letters, itself first."""
    less = lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.overlay(s, F.lit(""), i, F.lit(1)))).otherwise(F.array(s))
    out = F.array(text)
    for _ in range(most):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, less))))
    return out


def _entries(df: DataFrame, domains: list[str] | DataFrame, name: str) -> DataFrame:
    """Listed domains, given as a list or as the first column of a table, in lower case."""
    table = domains if isinstance(domains, DataFrame) else df.sparkSession.createDataFrame([(d,) for d in domains], "listed string")
    return table.select(F.lower(table.columns[0]).alias(name)).where(f"{name} <> ''").distinct()


def near_hosts(hosts: DataFrame, domains: list[str] | DataFrame, most: int = 2) -> DataFrame:
    """``hosts(host)`` -> ``(host, near)``: the first listed domain within ``most`` edits that is not the host itself.

    Two texts within so many edits have a string in common that is left after as many deletions on
    either side. Both sides are filed under hashes of these strings and joined on them; the edit
    distance decides. So the work follows hosts plus list, not their product. Hosts that are longer
    than any listed domain can explain are left out before they are expanded.
    """
    listed = _entries(hosts, domains, "listed")
    longest = listed.agg(F.max(F.length("listed"))).first()[0] or 0
    filed = lambda df, name: df.select(name, F.explode(F.transform(deletions(F.col(name), most), lambda s: F.xxhash64(s))).alias("key"))
    short = hosts.select("host").where((F.length("host") > 0) & (F.length("host") <= longest + most)).distinct()
    # Merged, not broadcast: the planner knows a list by its size before each entry becomes some 150 rows.
    pairs = filed(short, "host").hint("merge").join(filed(listed, "listed").hint("merge"), "key").where("host <> listed").select("host", "listed").distinct()
    return pairs.where(F.levenshtein("host", "listed", most).between(0, most)).groupBy("host").agg(F.min("listed").alias("near"))


def under(hosts: DataFrame, domains: list[str] | DataFrame) -> DataFrame:
    """``hosts(host)`` -> the hosts that are or lie under a listed domain, joined on the ends of their names."""
    labels = F.split("host", r"\.")
    ends = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("end"))
    return ends.join(_entries(hosts, domains, "end"), "end").select("host").distinct()


def lookalikes(messages: DataFrame, domains: list[str] | DataFrame, trusted: list[str] | DataFrame = (), column: str = "from_domain", most: int = 2) -> DataFrame:
    """Messages whose domain is within ``most`` edits of a listed one but neither equal nor trusted: ``near``.

    ``trusted`` domains cover what lies under them; in a list, ``/pattern/`` covers what it matches.
    """
    host = F.lower(column)
    near = near_hosts(messages.select(host.alias("host")), domains, most)
    if not isinstance(trusted, DataFrame):
        patterns = [F.col("host").rlike(e.strip("/")) for e in trusted if e.startswith("/")]
        near, trusted = near.where(~C.any_of(patterns)), [e for e in trusted if not e.startswith("/")]
    if isinstance(trusted, DataFrame) or trusted:
        near = near.join(under(near, trusted), "host", "left_anti")
    near = near.withColumnRenamed("host", "_host")
    return messages.join(near, host == F.col("_host")).drop("_host")


def with_lookalike_flag(messages: DataFrame, trusted: list[str], column: str = "from_domain") -> DataFrame:
    """Adds ``lookalike_domain``: the sender imitates a trusted domain or a common brand and is not trusted itself.

    The flag is joined by domain, so messages meet only a table of the distinct domains that imitate one.
    """
    names = [t for t in trusted if not t.startswith("/")]
    hosts = lookalikes(messages.select(F.lower(column).alias(column)).distinct(), [*names, *X.BRANDS], trusted, column).select(F.col(column).alias("_host"), F.lit(True).alias("lookalike_domain"))
    out = messages.join(hosts, F.lower(messages[column]) == F.col("_host"), "left").drop("_host")
    return out.withColumn("lookalike_domain", F.coalesce("lookalike_domain", F.lit(False)))


def brand_mismatches(messages: DataFrame) -> DataFrame:
    """Messages whose sender's name claims a brand that the domain is not."""
    pairs = messages.select("from_name", "from_domain").distinct()
    words = _list(messages, [(k, w, d) for k, (w, d) in enumerate(X.BRAND_KEYWORDS)], "k int, word string, brand string")
    claimed = pairs.join(words, F.lower("from_name").contains(F.col("word"))).groupBy("from_name", "from_domain").agg(F.min(F.struct("k", "brand")).alias("first"))
    wrong = claimed.where(~C.is_under(F.lower("from_domain"), F.col("first.brand"))).select("from_name", "from_domain", F.col("first.brand").alias("brand"))
    return messages.join(wrong, ["from_name", "from_domain"])


def trusted(messages: DataFrame, entries: list[str], column: str = "from_domain") -> DataFrame:
    """Messages whose domain is listed, under a listed one, or matches a listed ``/pattern/``."""
    hosts = messages.select(F.lower(column).alias("host")).where("host <> ''").distinct()
    tests = [F.col("host").rlike(e.strip("/")) if e.startswith("/") else C.is_under(F.col("host"), e.lower()) for e in entries]
    return messages.join(hosts.where(C.any_of(tests)), F.lower(messages[column]) == F.col("host"), "left_semi")


def confusables(messages: DataFrame, domains: list[str], skeletons: DataFrame, column: str = "from_domain") -> DataFrame:
    """Messages whose domain's skeleton (host, skeleton) is or lies under a listed domain that it is not."""
    labels = F.split("skeleton", r"\.")
    ends = skeletons.withColumn("end", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    hit = ends.join(_table(messages, [(d,) for d in domains], "end string"), "end").where(~C.is_under(F.col("host"), F.col("end"))).groupBy("host").agg(F.min("end").alias("imitates"))
    return messages.join(hit, messages[column] == hit["host"]).drop("host")


def host_categories(hosts: DataFrame, lists: dict[str, list[str]] = X.CATEGORIES) -> DataFrame:
    """``hosts(host)`` -> ``(host, category)``: keywords with a dot are joined on the ends of names, bare words searched."""
    words = [(n, w.lower()) for n, ws in lists.items() for w in ws]
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # The ends of a.b.c: a.b.c, b.c and c as domains, .b.c and .c as suffixes.
    ends = hosts.select("host", F.explode(F.concat(tails, F.transform(F.slice(tails, 2, F.size(labels)), lambda t: F.concat(F.lit("."), t)))).alias("word"))
    dotted, bare = [x for x in words if "." in x[1]], [x for x in words if "." not in x[1]]
    out = ends.join(_table(hosts, dotted, "category string, word string"), "word").select("host", "category")
    if bare:
        out = out.union(hosts.join(_list(hosts, bare, "category string, word string"), F.col("host").contains(F.col("word"))).select("host", "category"))
    return out.distinct()


def categories(messages: DataFrame, lists: dict[str, list[str]] = X.CATEGORIES) -> DataFrame:
    """``(path, categories)``: sorted names of the categories of any of ``domains`` (an array)."""
    pairs = messages.select("path", F.explode("domains").alias("host")).where("host <> ''").distinct()
    hosts = host_categories(pairs.select("host").distinct(), lists)
    return pairs.join(hosts, "host").groupBy("path").agg(F.sort_array(F.collect_set("category")).alias("categories"))


def enriched(messages: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Left join of stored answers or recognised texts by their key."""
    return messages.join(texts, key, "left")


def missing(messages: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Keys still to be looked up."""
    return messages.select(key).where(F.col(key).isNotNull()).distinct().join(texts, key, "left_anti")
