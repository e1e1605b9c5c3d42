"""URL filter: rules first, else gradient-boosted trees on lexical features. DataFrame operations only.

Rules are (host, path, verdict): a rule fits its host and all subdomains if the url's path starts with the rule's;
of several the longest wins. Urls that a rule decides are the labelled set. The trees are fitted on at most SAMPLE of them, those of the
smallest hash of url and id; each level of each tree is one grouped aggregate of gradients over (node, feature, bin), whose result has
at most nodes x features x bins rows. The trees become one SQL expression, so scoring is a plain projection.

Features: length, depth, digit ratio, entropy of the characters, parameter count, host depth, hyphens, and suffix statistics: the smoothed
block rate of the host's last label among labelled urls; the SUFFIXES most frequent ones have one of their own, others the prior rate.

What rules alone say must not come back as a feature: a suffix all of whose labels are the same verdict (every label under net is a block rule's) tells
nothing of how its blocked and allowed urls differ, and any feature that names it would only repeat the rule. Its labelled urls are left out of the fit, and it
gets the prior rate, as does a suffix without labels. So urls of such suffixes are judged by their form. held_out() measures a fit on hosts that it has not seen.

A null url, or one without "://", has an empty host and path and is judged by the trees like any other.
Without a suffix that has labels of both verdicts everything undecided is allowed. Repeated rows get the same verdict. An empty table gives an empty result.
Columns other than the id and the url are not read, so their names may clash with those used here.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ascii_lower, materialise, read_table

# The contract's rules.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Bounds of the fit: labelled rows, distinct suffixes, trees, depth, bins of a feature.
SAMPLE, SUFFIXES, TREES, DEPTH, BINS = 20_000, 200, 10, 3, 16
RATE, SHRINK = 0.3, 1.0
#: A url that no rule decides is blocked above this probability, with both verdicts weighing the same in the fit.
BLOCK_ABOVE = 0.7


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query)."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"\A([^/?#]*)", 1)), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"\A[^?#]*\?([^#]*)", 1)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    """Bits per character, from counts of a-z, digits and the marks of urls; other characters count as one class."""
    n = F.greatest(F.length(text), F.lit(1))
    letters = "abcdefghijklmnopqrstuvwxyz0123456789/.-_=&?%"
    counts = [F.length(text) - F.length(F.translate(text, c, "")) for c in letters]
    counts.append(F.length(F.translate(text, letters, "")))
    return functools.reduce(lambda a, b: a + b, [F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(0.0) for c in counts])


def features(url: Column, host: Column, path: Column, query: Column) -> dict[str, Column]:
    whole = ascii_lower(F.coalesce(url, F.lit("")))
    size = F.length(whole)
    digits = size - F.length(F.translate(whole, "0123456789", ""))
    marks = lambda text, c: F.length(text) - F.length(F.translate(text, c, ""))
    return {
        "length": size.cast("double"),
        "depth": marks(path, "/").cast("double"),
        "digit_ratio": digits / F.greatest(size, F.lit(1)),
        "entropy": _entropy(whole),
        "parameters": F.when(query == "", 0.0).otherwise(marks(query, "&") + 1.0),
        "host_depth": marks(host, ".").cast("double"),
        "hyphens": marks(whole, "-").cast("double"),
        "path_length": F.length(path).cast("double"),
    }


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _tree_sql(node: dict, leaf: str, binned: bool) -> str:
    """The tree as nested CASE, with each leaf's `leaf` entry; on bins while it is grown, on features for scoring."""
    if "feature" not in node:
        return repr(float(node[leaf])) + "D" if leaf == "value" else str(node[leaf])
    test = f"b{node['feature']} <= {node['bin']}" if binned else f"{node['name']} <= {float(node['cut'])!r}D"
    return f"CASE WHEN {test} THEN {_tree_sql(node['low'], leaf, binned)} ELSE {_tree_sql(node['high'], leaf, binned)} END"


class UrlModel:
    """score(rows) in log-odds of block. names: feature columns; cuts: bin edges of each."""

    def __init__(self, base: float, suffix_rates: dict[str, float], default_rate: float, trees: list[dict]):
        self.base, self.suffix_rates, self.default_rate, self.trees = base, suffix_rates, default_rate, trees

    def suffix_rate(self, host: Column) -> Column:
        if not self.suffix_rates:
            return F.lit(self.default_rate)
        pairs = [x for k, v in sorted(self.suffix_rates.items()) for x in (F.lit(k), F.lit(v))]
        return F.coalesce(F.element_at(F.create_map(*pairs), suffix(host)), F.lit(self.default_rate))

    def score(self, binned: bool = False) -> Column:
        return functools.reduce(lambda a, b: a + b, [F.expr(_tree_sql(t, "value", binned)) for t in self.trees], F.lit(self.base))


def with_features(rows: DataFrame, model: UrlModel) -> DataFrame:
    """rows: (url, host, path, query, ...)."""
    columns = features(F.col("url"), F.col("host"), F.col("path"), F.col("query"))
    return rows.select("*", *(c.alias(k) for k, c in columns.items()), model.suffix_rate(F.col("host")).alias("suffix_rate"))


def fit(labelled: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH) -> UrlModel | None:
    """Fits on (url, host, path, query, block[, id]) with block 0 or 1; at most `sample` rows, those of the smallest hash of url and id."""
    tail = suffix(F.col("host"))
    mixed = materialise(labelled.groupBy(tail.alias("s")).agg(F.count("*").alias("n"), F.sum("block").alias("b")).where("b > 0 and b < n"), "suffixes")
    said = mixed.orderBy(F.desc("n"), "s").limit(SUFFIXES).collect()
    if not said:
        return None
    size = mixed.agg(F.sum("n")).first()[0]
    rank = F.xxhash64("url", *(["id"] if "id" in labelled.columns else []))
    usable = labelled.join(mixed.select("s"), tail == F.col("s"), "left_semi").select("url", "host", "path", "query", "block", rank.alias("rank"))
    if size > sample:  # a little more than asked for, then exactly the first
        usable = usable.where(F.pmod("rank", F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.1 * sample / size))).orderBy(F.pmod("rank", F.lit(1 << 30)), "rank").limit(sample)
    chosen = materialise(usable.drop("rank"), "labelled")
    total, ones = chosen.agg(F.count("*"), F.sum("block")).first()
    if not total or not ones or ones == total:
        return None
    mean = ones / total
    known = {r["s"]: (r["b"] + 2 * mean) / (r["n"] + 2) for r in said}
    model = UrlModel(0.0, known, mean, [])
    names = [*features(*[F.lit("")] * 4), "suffix_rate"]
    rows = with_features(chosen, model)
    edges = rows.agg(*(F.percentile_approx(n, [i / BINS for i in range(1, BINS)]).alias(n) for n in names)).first()
    cuts = [sorted(set(edges[n])) for n in names]
    bins = [functools.reduce(lambda a, c, n=n: a + (F.col(n) > c).cast("int"), cuts[k], F.lit(0)).alias(f"b{k}") for k, n in enumerate(names)]
    weight = F.when(F.col("block") == 1, 0.5 / mean).otherwise(0.5 / (1 - mean))  # both verdicts weigh the same
    rows = materialise(rows.select("block", weight.alias("w"), *bins).coalesce(1), "bins")  # at most `sample` rows of a few numbers
    every = F.explode(F.array(*(F.struct(F.lit(k).alias("f"), F.col(f"b{k}").alias("b")) for k in range(len(names)))))
    for _ in range(trees):
        tree = {"id": 1, "value": 0.0}
        growing = [tree]
        p = 1 / (1 + F.exp(-model.score(binned=True)))
        for _level in range(depth):
            node = F.expr(_tree_sql(tree, "id", True))
            grown = rows.select(node.alias("node"), (F.col("w") * (F.col("block") - p)).alias("g"), (F.col("w") * p * (1 - p)).alias("h"), every.alias("x"))
            sums: dict[int, dict[tuple[int, int], tuple[float, float]]] = {}
            for r in grown.groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                sums.setdefault(r["node"], {})[r["f"], r["b"]] = (r["g"], r["h"])
            growing = [child for at in growing for child in _split(at, sums.get(at["id"], {}), names, cuts)]
            if not growing:
                break
        model.trees.append(tree)
    return model


def _split(at: dict, own: dict[tuple[int, int], tuple[float, float]], names: list[str], cuts: list[list[float]]) -> list[dict]:
    """Splits a node where the gain is largest, first feature and lowest cut on ties; gives the new leaves."""
    g, h = (sum(v[k] for (f, _), v in own.items() if f == 0) for k in (0, 1))
    best, found = 1e-3, None
    for f, edges in enumerate(cuts):
        gl = hl = 0.0
        for b in range(len(edges)):
            more = own.get((f, b), (0.0, 0.0))
            gl, hl = gl + more[0], hl + more[1]
            if hl < 1 or h - hl < 1:
                continue
            gain = gl * gl / (hl + SHRINK) + (g - gl) ** 2 / (h - hl + SHRINK) - g * g / (h + SHRINK)
            if gain > best + 1e-9:
                best, found = gain, (f, b, gl, hl)
    if found is None:
        at["value"] = RATE * g / (h + SHRINK)
        return []
    f, b, gl, hl = found
    low = {"id": 2 * at["id"], "value": RATE * gl / (hl + SHRINK)}
    high = {"id": 2 * at["id"] + 1, "value": RATE * (g - gl) / (h - hl + SHRINK)}
    at |= {"feature": f, "bin": b, "name": names[f], "cut": cuts[f][b], "low": low, "high": high}
    return [low, high]


def _ruled(pages: DataFrame, rules, id_col: str, url_col: str) -> DataFrame:
    """(page_id, url, host, path, query, rule, said)."""
    host, path, query = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"), query.alias("query"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    return rows.withColumn("rule", rule).withColumn("said", said)


def _labelled(rows: DataFrame) -> DataFrame:
    return rows.where("rule is not null").select(F.col("page_id").alias("id"), "url", "host", "path", "query", (F.col("said") == "block").cast("int").alias("block"))


def judge(pages: DataFrame, rules=RULES, sample: int = SAMPLE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, block_probability): one row per input row."""
    rows = _ruled(pages, rules, id_col, url_col)
    model = fit(_labelled(rows), sample)
    if model is None:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("said", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("block_probability"))
    scored = with_features(rows, model).withColumn("block_probability", 1 / (1 + F.exp(-model.score())))
    verdict = F.coalesce("said", F.when(F.col("block_probability") > BLOCK_ABOVE, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_probability")


def held_out(pages: DataFrame, rules=RULES, folds: int = 5, sample: int = SAMPLE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(block, urls, blocked, probability) of labelled urls whose hosts the fit has not seen: one host in `folds`, by hash. probability is the mean."""
    rows = _labelled(_ruled(pages, rules, id_col, url_col)).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(folds)))
    model = fit(rows.where("fold <> 0"), sample)
    said = F.lit(0.0) if model is None else 1 / (1 + F.exp(-model.score()))
    rest = rows.where("fold = 0")
    scored = (rest if model is None else with_features(rest, model)).withColumn("p", said)
    return scored.groupBy("block").agg(F.count("*").alias("urls"), F.count_if(F.col("p") > BLOCK_ABOVE).alias("blocked"), F.avg("p").alias("probability"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"))


def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op10 SQL can express: hosts, paths and rules, and the verdicts that follow from them."""
    return op10(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("said"))


RULED_SQL = r"""
WITH rules(rule_host, rule_path, what) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
best AS (SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(what, length(rule_host || rule_path)) AS said
         FROM h JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT h.page_id, host, path, rule, said FROM h LEFT JOIN best ON h.page_id = best.page_id
"""
