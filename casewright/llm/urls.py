"""URL filtering: fixed host and path rules, then association rules mined by FP-growth.

Labelled URLs become token baskets; frequent token combinations that predict a
blocked page with enough support and confidence become rules. Rules are
matched through an inverted index (token to rules): a rule fires on a URL that
has all its tokens. Everything is DataFrame work.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import bounded_sample, checkpointed, free_name

#: Fixed base rules: verdict, host, path.
BASE_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Bound of the labelled sample (pages of lowest hash of their url) that rules are mined from.
SAMPLE_PAGES = 200_000
#: Pruning of mined rules: so many blocked pages at every size; confidence; lift.
LEAST_PAGES, MIN_CONFIDENCE, MIN_LIFT = 20, 0.8, 1.5
#: The token that stands for a blocked page in a labelled basket; URL tokens have no space.
_BLOCKED = "label block"
#: Rules up to this number are broadcast; more are joined by shuffle.
BROADCAST_RULES = 20_000


def url_host(url: Column) -> Column:
    """After the first ://, up to /, ?, # or the end, with A-Z lower-cased; empty for null or no ://."""
    host = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_query(url: Column) -> Column:
    """What follows the first ? up to # or the end; empty for null or none."""
    return F.coalesce(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column, query: Column | None = None) -> Column:
    """Distinct tokens: the whole host, words of host and path, and the names of query parameters."""
    words = F.transform(F.filter(F.split(F.lower(F.concat_ws("/", host, path)), "[^a-z]+"), lambda w: F.length(w) > 1), lambda w: F.concat(F.lit("word:"), w))
    names = F.transform(F.split(F.coalesce(query, F.lit("")) if query is not None else F.lit(""), "&"), lambda p: F.concat(F.lit("query:"), F.split_part(p, F.lit("="), F.lit(1))))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("host:"), host)), words, F.filter(names, lambda n: n != "query:")))


def tokens_of(url: Column) -> Column:
    return url_tokens(url_host(url), url_path(url), url_query(url))


def base_verdict(host: Column, path: Column, rules: list[tuple[str, str, str]] | None = None) -> tuple[Column, Column]:
    """Name (host and path) and verdict of the longest base rule that fits; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(BASE_RULES if rules is None else rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def mine_rules(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", min_support: float = 0.0, least_pages: int = LEAST_PAGES, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """Rules rule_id, tokens, confidence, lift, support that predict blocked pages.

    FP-growth finds the frequent sets of tokens of the labelled pages, with the
    label as one more token. A set is a rule if it is seen on least_pages
    blocked pages (and on the share min_support of all), and enough of the pages
    that hold it are blocked. At most sample_pages labelled pages are mined.
    Rows with a null url or label teach nothing; no rows give no rules.
    """
    known = labelled.where(F.col(url_col).isNotNull() & F.col(label_col).isNotNull())
    # Pages that share a url and a label are told apart by a row number, so that a hot url is sampled like any other.
    rows = checkpointed(known.select(F.col(url_col), F.col(label_col), F.monotonically_increasing_id().alias("_row")))
    sample = bounded_sample(rows, "_row", sample_pages)
    tokens = tokens_of(F.col(url_col))
    baskets = checkpointed(sample.select(F.when(F.col(label_col).cast("int") == 1, F.concat(tokens, F.array(F.lit(_BLOCKED)))).otherwise(tokens).alias("items")))
    pages, blocked = baskets.agg(F.count("*"), F.count_if(F.array_contains("items", _BLOCKED))).first()
    support = max(min_support, least_pages / max(1, pages))  # a rule seen on two pages is chance
    if support > 1 or not blocked:
        return labelled.sparkSession.createDataFrame([], "rule_id long, tokens array<string>, confidence double, lift double, support double")
    sets = checkpointed(FPGrowth(itemsCol="items", minSupport=support).fit(baskets).freqItemsets.select(F.array_sort("items").alias("items"), "freq"))
    with_label = sets.where(F.array_contains("items", _BLOCKED) & (F.size("items") > 1)).select(F.array_remove("items", _BLOCKED).alias("items"), F.col("freq").alias("hits"))
    rules = with_label.join(sets, "items").select(F.xxhash64("items").alias("rule_id"), F.col("items").alias("tokens"), (F.col("hits") / F.col("freq")).alias("confidence"), (F.col("hits") / F.col("freq") * pages / blocked).alias("lift"), (F.col("hits") / pages).alias("support"))
    return rules.where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """All columns of pages and host, path, rule, verdict, n_mined.

    verdict is that of the longest base rule that fits, else block if a mined
    rule fires, else allow. n_mined counts the mined rules that fire. Null urls
    and urls without :// have empty host and path, no rule and the verdict
    allow. Repeated rows and null ids are judged each time; new names get
    underscores where the input has them.
    """
    names, new = pages.columns, []
    for n in ("host", "path", "rule", "verdict", "n_mined"):
        new.append(free_name(n, [*names, *new]))
    host, path, rule, verdict, mined = new
    url = F.col(url_col)
    index = checkpointed(rules.select("rule_id", F.size("tokens").alias("_size"), F.explode("tokens").alias("_token")))
    if index.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    # Equal urls fire the same rules: the index is probed once for each distinct url.
    distinct = pages.where(url.isNotNull()).select(url.alias("_url")).distinct()
    probes = distinct.select("_url", F.explode(tokens_of(F.col("_url"))).alias("_token"))
    fired = probes.join(index, "_token").groupBy("_url", "rule_id", "_size").count().where("count = _size").groupBy("_url").agg(F.count("*").alias("_fired"))
    judged = pages.join(fired, url.eqNullSafe(F.col("_url")), "left").drop("_url")
    name, base = base_verdict(F.col(host), F.col(path))
    found = F.coalesce(F.col("_fired"), F.lit(0))
    judged = judged.withColumn(host, url_host(url)).withColumn(path, url_path(url)).withColumn(rule, name)
    judged = judged.withColumn(verdict, F.coalesce(base, F.when(found > 0, F.lit("block")).otherwise(F.lit("allow")))).withColumn(mined, found.cast("long"))
    return judged.select(*(F.col(f"`{c}`") for c in [*names, *new]))
