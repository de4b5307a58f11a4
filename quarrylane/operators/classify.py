"""Weighted keyword classification of documents by a rule table."""

from __future__ import annotations

import re

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.slugs import file_mark, fuse_file_mark
from ..functions.text import let, one_case

# The rules that apply where an organisation has none of its own: type, pattern, weight.
RULES = [
    ("UPD", r"универсальный\s+передаточный\s+документ|(?<![а-яёa-z])упд(?![а-яёa-z])", 1.0),
    ("CMR", r"\bCMR\b|международная\s+товарно-транспортная", 1.0),
    ("TTN", r"транспортная\s+накладная|товарно-транспортная\s+накладная|(?<![а-яёa-z])ттн(?![а-яёa-z])", 1.0),
    ("factInvoice", r"счет-фактура|счёт-фактура", 1.0),
    ("AKT", r"(?<![а-яёa-z])акт(?![а-яёa-z])\s+(оказанных|выполненных|сдачи)|акт\s+об\s+оказании", 0.95),
    ("invoice", r"сч[её]т\s+на\s+оплату|сч[её]т\s+№", 0.9),
    ("invoice", r"сч[её]т", 0.6),
    ("waybill", r"путевой\s+лист|форма\s+4-С|форма\s+4-П|форма\s+ПЛ-1", 1.0),
    ("transport_invoice", r"Постановлен[а-яА-Я]+\s+Правительства\s+РФ.{0,80}272|приложение\s+№\s*4\s+к\s+Правилам\s+перевозок\s+грузов|условия\s+перевозки.{0,500}стоимость\s+услуг\s+перевозки", 1.1),
    ("transport_request", r"заявка\s+(?:№|на\s+перевозку|на\s+транспортные\s+услуги|на\s+автоперевозку|на\s+транспортно-экспедиционн)|заявка-договор\s+на\s+перевозку|заявка-договор\s*№|заявк[аи][^\n]{0,100}транспортно-экспедиционн|заявка\s+на\s+оказание\s+транспортн", 1.0),
]


#: Characters of a text that rules read.
HEAD = 4000

# The edge of a run of ASCII letters, digits and underscores: what \b means is another thing in every version of the JVM.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_EDGES = r"(?<!\\)((?:\\\\)*)\\b"


# Keywords that are plain words, with blanks or \\s+ between them.
_PLAIN = r"^(?:[0-9A-Za-zА-Яа-яЁё ]|\\s\+)+$"


def as_pattern(keyword: str) -> str:
    """A keyword as a pattern that ignores case and whose word edges are ASCII."""
    return "(?iu)" + re.sub(_EDGES, lambda m: m[1] + EDGE, keyword)


def keyword_rules(slug: str, keywords: list[str], weights: list[float | None], default: float | None = None) -> list[tuple[str, str, float]]:
    """Rules of a type's keywords: each has its own weight, else the type's, else 1; keywords that are no patterns are left
    out."""
    out = []
    for k, w in zip(keywords, weights + [None] * len(keywords), strict=False):
        try:
            re.compile(k)
        except re.error:
            continue
        out.append((slug, k, 1.0 if (w is None and default is None) else w if w is not None else default))
    return out


def classify(docs: DataFrame, rules: list[tuple[str, str, float]], head: int = HEAD, title: int = 500) -> DataFrame:
    """id, slug, score, runner_up: each rule (slug, pattern, weight) that the first ``head`` characters match scores its
    weight, 1.5 times within the first ``title``. A type keeps its best rule; ties go to the longer match, then the slug.

    Rules are few, so they are literal columns; a document's types are ranked within its row."""
    text = F.substring("text", 1, head)
    found = []
    for slug, pattern, weight in rules:
        p = as_pattern(pattern)
        hit = F.regexp_extract(text, p, 0)
        at = F.regexp_instr(text, F.lit(p))
        found.append(F.when(text.rlike(p), F.struct((F.lit(weight) * F.when(at <= title, 1.5).otherwise(1.0)).alias("weight"), F.length(hit).alias("size"), F.lit(slug).alias("slug"))))
    ranked = F.array_sort(F.transform(F.array_compact(F.array(*found)), lambda h: F.struct((-h["weight"]).alias("w"), (-h["size"]).alias("n"), h["slug"].alias("slug"))))
    d = docs.select("id", ranked.alias("r")).withColumn("best", F.get("r", F.lit(0)))
    second = F.get(F.filter("r", lambda h: h["slug"] != F.col("best.slug")), F.lit(0))
    return d.select("id", F.col("best.slug").alias("slug"), F.when(F.col("best").isNotNull(), F.least(F.lit(1.0), -F.col("best.w"))).alias("score"), second["slug"].alias("runner_up"))


def _folded(text: Column) -> Column:
    """A text in one case and with one blank for each run of white space."""
    return F.regexp_replace(one_case(text), r"\s+", " ")


def _sought(keyword: Column) -> Column:
    """What the folded text holds if a keyword of plain words matches; nothing, which all texts hold, for other keywords."""
    return F.when(keyword.rlike(_PLAIN), _folded(F.replace(keyword, F.lit(r"\s+"), F.lit(" ")))).otherwise("")


def rules_by_scope(types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables of rules (arrays of slug, pattern, weight, sought): one row for each scope, and one row of those of all scopes.

    ``types`` has scope (null: all), slug, keywords, weights, weight and active. A keyword without weight of its own has its
    type's, else 1; keywords that are no patterns are left out, by the engine that will match them."""
    each = types.where("active").select("scope", "slug", "weight", "weights", F.posexplode("keywords").alias("place", "word"))
    each = each.withColumn("pattern", F.concat(F.lit("(?iu)"), F.regexp_replace("word", _EDGES, "$1" + EDGE.replace("\\", r"\\"))))
    valid = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("pattern")).isNotNull()
    rule = F.struct("slug", "place", "pattern", F.coalesce(F.get("weights", F.col("place")), F.col("weight"), F.lit(1.0)).cast("double").alias("weight"), _sought(F.col("word")).alias("sought"))
    rules = F.transform(F.array_sort(F.collect_list(rule)), lambda r: F.struct(r["slug"], r["pattern"], r["weight"], r["sought"]))
    each = each.where(valid)
    return each.where("scope IS NOT NULL").groupBy("scope").agg(rules.alias("own")), each.where("scope IS NULL").agg(rules.alias("shared"))


def _hits(head: Column, folded: Column, rules: Column, title: int) -> Column:
    """slug, weight, matched, in_title and place of each rule that the text matches. The pattern is tried only where the
    folded text holds what it needs: compiling it and trying it at each character costs far more."""

    def hit(r: Column, i: Column) -> Column:
        matched = F.call_function("regexp_extract", head, r["pattern"], F.lit(0))
        weight = lambda at: F.when(at <= title, r["weight"] * 1.5).otherwise(r["weight"])
        of = lambda at: F.when(at > 0, F.struct(r["slug"], weight(at).alias("weight"), matched.alias("matched"), (at <= title).alias("in_title"), i.alias("place")))
        return F.when(F.contains(folded, r["sought"]), let(F.regexp_instr(head, r["pattern"]), of))

    return F.array_compact(F.transform(rules, hit))


def classify_scoped(docs: DataFrame, types: DataFrame, builtin: Sequence[tuple[str, str, float]] = tuple(RULES), head: int = HEAD, title: int = 500) -> DataFrame:
    """id, slug, score, matched, candidates, rules and ranked of docs (id, scope, text, name) by the rules of their scope.

    The rules of a scope and of all scopes come first; only where none of them matches do the built-in ones apply, and
    ``rules`` says which did (own or builtin). A type counts with its best match, and types rank by weight, length of
    the match and slug; the winner of a full tie is the type that matched first. Then the file's name has its say.
    ``ranked`` holds the winner and the other types that the text matched, with scores of 1 at most.

    A document is judged by itself: its scope's rules come to it as one array, by a join on the scope, so no text is copied
    or shuffled for a rule. A null text matches nothing; a null scope has only the rules of all scopes."""
    own, shared = rules_by_scope(types)
    d = docs.join(own, "scope", "left").crossJoin(F.broadcast(shared))  # one row, of rules that people wrote
    none = F.array().cast("array<struct<slug:string,pattern:string,weight:double,sought:string>>")
    fixed = F.array(*[F.struct(F.lit(s).alias("slug"), F.lit(as_pattern(p)).alias("pattern"), F.lit(float(w)).alias("weight"), F.lit("").alias("sought")) for s, p, w in builtin])
    start = F.substring(F.coalesce("text", F.lit("")), 1, head)
    texts = let(start, lambda t: F.struct(t.alias("head"), _folded(t).alias("folded")))
    own_rules = F.concat(F.coalesce("own", none), F.coalesce("shared", none))
    found = lambda t: let(_hits(t["head"], t["folded"], own_rules, title), lambda h: F.struct((F.size(h) > 0).alias("mine"), F.when(F.size(h) > 0, h).otherwise(_hits(t["head"], t["folded"], fixed, title)).alias("hits")))
    d = d.select("id", "name", let(texts, found).alias("f")).select("id", "name", "f.*")
    order = F.array_sort(F.transform("hits", lambda h: F.struct((-h["weight"]).alias("w"), (-F.length(h["matched"])).alias("n"), h["slug"].alias("slug"), h["place"].alias("place"), h["matched"].alias("matched"), h["in_title"].alias("in_title"))))
    d = d.withColumn("sorted", order)
    first_of_type = lambda h, i: F.size(F.filter(F.slice(F.col("sorted"), F.lit(1), i), lambda o: o["slug"] == h["slug"])) == 0
    d = d.withColumn("types", F.filter("sorted", first_of_type))
    earliest = lambda h: F.array_min(F.transform(F.filter("hits", lambda o: o["slug"] == h["slug"]), lambda o: o["place"]))
    best = F.array_min(F.transform("types", lambda h: F.struct(h["w"], h["n"], earliest(h).alias("at"), h["slug"], h["matched"], h["in_title"])))
    d = d.withColumn("best", best).withColumn("mark", file_mark(F.col("name")))
    marked = F.get(F.filter("types", lambda h: h["slug"] == F.col("mark")), F.lit(0))
    fused = fuse_file_mark(F.col("best.slug"), -F.col("best.w"), F.coalesce("best.in_title", F.lit(False)), F.col("mark"), -marked["w"])
    d = d.withColumn("won", fused)
    capped = lambda w: F.least(F.lit(1.0), w)
    slug = F.col("won.slug")
    score = F.when(slug.isNull(), 0.0).otherwise(capped(F.col("won.weight")))
    matched = F.when(slug == F.col("best.slug"), F.col("best.matched")).otherwise(F.coalesce(marked["matched"], F.concat(F.lit("filename:"), slug)))
    others = F.transform(F.filter("types", lambda h: h["slug"] != slug), lambda h: F.struct(h["slug"], capped(-h["w"]).alias("score")))
    ranked = F.when(slug.isNotNull(), F.concat(F.array(F.struct(slug.alias("slug"), score.alias("score"))), others))
    source = F.when(F.col("mine"), "own").when(F.size("hits") > 0, "builtin")
    return d.select("id", slug.alias("slug"), score.alias("score"), matched.alias("matched"), F.size("hits").alias("candidates"), source.alias("rules"), ranked.alias("ranked"))
