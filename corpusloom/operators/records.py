"""Operators over records as a whole: items, passages, answers and failures. Nulls pass as stated; empty tables give empty results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import has_any, strip

# Severities from worst to none, failures by severity, and keywords with their meaning.
SEVERITIES = ["critical", "high", "medium", "low", "none"]
# What marks a comparison, a time and a quantity in a question.
COMPARISON, TEMPORAL, QUANTITY = ["or", "versus", "vs", "between", "differ"], ["before", "after", "during", "within", "deadline"], ["how much", "how many", "amount", "number"]
# Legal terms that are key concepts of an answer.
CONCEPT_TERMS = ["liability", "negligence", "contract", "damages", "breach", "jurisdiction", "remedy", "offense", "appeal"]
# What scanning leaves in consolidated texts, and what replaces it, in this order.
ARTEFACTS = [
    ("(?i)The Constitution of the Democratic Socialist Republic of Sri Lanka\\s+\\d+(?:\\s+\\d+)?", ""),
    ("(?i)(The Constitution.*?Sri Lanka)\\s+\\d+(?:\\s+\\d+)?(?:\\s+(law|section|The|Constitution))?", "$1"),
    ("(?i)\\s(\\d{1,3})\\s+(The Constitution|law|section|Constitution)", " $2"),
    ("(?i)(Cap\\.|Vol\\.|Page)\\s+\\d+", ""),
    ("\\n{3,}", "\n\n"),
    (" {2,}", " "),
]
# Topics that stand for a bare article number.
ARTICLE_TOPICS = {
    "1": "Democratic Socialist Republic free sovereign independent", "2": "unitary State", "3": "sovereignty of the People inalienable", "4": "legislative power executive power judicial power fundamental rights",
    "9": "Buddhism foremost place Buddha Sasana protect and foster", "10": "freedom of thought conscience religion", "11": "torture cruel inhuman degrading treatment punishment", "12": "equality before the law equal protection discrimination",
    "13": "freedom from arbitrary arrest detention personal liberty", "14": "freedom of speech expression publication assembly association movement", "14A": "right to access to information", "15": "restrictions on fundamental rights prescribed by law",
    "16": "existing written law inconsistent with fundamental rights", "17": "remedies for infringement of fundamental rights Supreme Court", "18": "official language Sinhala", "19": "national languages Sinhala Tamil", "20": "Tamil language rights administration",
    "22": "Tamil official language administration record proceedings", "30": "President Head of State executive Commander-in-Chief elected", "33": "powers duties functions of the President", "38": "removal of President impeachment two-thirds majority",
    "42": "Cabinet of Ministers collectively responsible Parliament", "43": "appointment of Ministers Prime Minister", "55": "Public Service Commission appointment transfer dismissal", "70": "dissolution of Parliament summon prorogue", "83": "entrenched provisions two-thirds majority referendum",
    "89": "disqualification electors register", "91": "disqualification Members of Parliament", "99": "proportional representation electoral districts seats", "105": "Supreme Court Court of Appeal jurisdiction", "107": "removal of judges address Parliament",
    "111": "Court of Appeal jurisdiction appellate", "126": "fundamental rights application Supreme Court relief redress", "129": "advisory opinion Supreme Court President", "138": "Court of Appeal jurisdiction", "154": "Ombudsman Parliamentary Commissioner administration", "155": "public security emergency regulations",
}


def scrubbed(c: Column) -> Column:
    """A text without the artefacts of scanning, in the order of the list, trimmed."""
    for pattern, by in ARTEFACTS:
        c = F.regexp_replace(c, pattern, by)
    return strip(c)


def extracted(layer: Column, recognised: Column, least: int = 100) -> Column:
    """The text layer if it has more than ``least`` visible characters, else the recognised text."""
    return F.when(F.length(strip(layer)) > least, layer).otherwise(recognised)


def with_article_topics(query: Column) -> Column:
    """The query and, behind it, the topics of the articles it names, in the order of mention and as often as named."""
    pairs = F.create_map(*[F.lit(x) for kv in ARTICLE_TOPICS.items() for x in kv])
    topics = F.filter(F.transform(F.regexp_extract_all(query, F.lit("(?i)\\bArticle\\s+(\\d+[A-Z]?)\\b"), F.lit(1)), lambda a: F.element_at(pairs, a)), lambda t: t.isNotNull())
    return F.when(F.size(topics) > 0, F.concat_ws(" ", query, F.array_join(topics, " "))).otherwise(query)


def expand_by_table(queries: DataFrame, concepts: DataFrame) -> DataFrame:
    """(query_id, retrieval_query): each query followed by the distinct terms of the concepts that occur in it.

    queries: query_id, query; concepts: pos int, concept string, terms array<string>, a vocabulary file of at most some thousand
    rows: it is turned into one array, checked for that bound, and looked up row by row without a join over pairs.
    """
    rows = concepts.orderBy("pos").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 concepts: join them by their words instead")
    if not rows:
        return queries.select("query_id", F.col("query").alias("retrieval_query"))
    table = F.array(*[F.struct(F.lit(r.concept).alias("c"), F.array(*[F.lit(t) for t in r.terms]).alias("t")) for r in rows])
    extra = F.array_distinct(F.flatten(F.transform(F.filter(table, lambda x: F.lower("query").contains(x["c"])), lambda x: x["t"])))
    return queries.select("query_id", F.when(F.size(extra) > 0, F.concat_ws(" ", "query", F.array_join(extra, " "))).otherwise(F.col("query")).alias("retrieval_query"))


def traits(query: Column) -> list[Column]:
    """The flags of a question that depend on substrings, and its difficulty by length."""
    low, n = F.lower(query), F.size(F.split(strip(query), "\\s+"))
    return [has_any(low, COMPARISON).alias("has_comparison"), has_any(low, TEMPORAL).alias("has_temporal"), has_any(low, QUANTITY).alias("has_quantifier"), F.when(n < 10, "easy").when((n > 25) | low.contains("interpret"), "hard").otherwise("medium").alias("difficulty")]


def filter_items(items: DataFrame, domain: str | None = None, query_type: str | None = None, ids: Sequence[str] | None = None) -> DataFrame:
    """Items of a domain, of a type, or with one of the ids, given as a list or as 'FIRST-LAST' with a common prefix."""
    for c, v in (("legal_domain", domain), ("query_type", query_type)):
        items = items if v is None else items.filter(F.col(c) == v)
    if isinstance(ids, str):
        lo, hi = (x.strip() for x in ids.split("-", 1))
        digits = "(\\d+)$"
        stem = F.regexp_replace("item_id", digits, "")
        n = F.regexp_extract("item_id", digits, 1).cast("bigint")
        import re

        a, b = re.search(digits, lo), re.search(digits, hi)
        return items.filter((stem == lo[: a.start()]) & n.between(int(a[0]), int(b[0])))
    return items if ids is None else items.filter(F.col("item_id").isin(list(ids)))


def severity_order(severity: Column) -> Column:
    """0 for the worst; unknown severities come last."""
    at = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)
    return F.when(F.coalesce(at, F.lit(0)) == 0, F.lit(len(SEVERITIES))).otherwise(at - 1).cast("int")


def at_least(severity: Column, least: str) -> Column:
    return severity_order(severity) <= SEVERITIES.index(least)


def examples(rows: DataFrame, by: Sequence[str], order: Sequence[str], k: int = 3) -> DataFrame:
    """The first ``k`` rows of each group with their place."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= k)


def key_concepts(answer: Column, cited: Column, most: int = 10) -> Column:
    """array<struct(concept, type)>: cited provisions, then legal terms of the text; repeats by lower case once, at most ``most``. ``cited``: array of labels."""
    low = F.lower(answer)
    terms = F.filter(F.array(*[F.when(low.contains(t), F.initcap(F.lit(t))) for t in CONCEPT_TERMS]), lambda x: x.isNotNull())
    tag = lambda a, name: F.transform(a, lambda x: F.struct(x.alias("concept"), F.lit(name).alias("type")))
    every = F.concat(tag(F.coalesce(cited, F.array().cast("array<string>")), "statute"), tag(terms, "legal_term"))
    keys = F.transform(every, lambda x: F.lower(x["concept"]))
    first = F.filter(F.transform(every, lambda x, i: F.struct(x.alias("x"), (F.array_position(keys, F.lower(x["concept"])) == i + 1).alias("first"))), lambda y: y["first"])
    return F.slice(F.transform(first, lambda y: y["x"]), 1, most)


def summary(answer: Column) -> Column:
    """The first two sentences, else the first 200 characters."""
    parts = F.split(answer, "\\.")
    return F.when(F.size(parts) >= 2, F.concat(F.array_join(F.slice(parts, 1, 2), ". "), F.lit("."))).otherwise(F.concat(F.substring(answer, 1, 200), F.lit("...")))


def simple_confidence(sufficient: Column, faithfulness: Column, conflicts: Column) -> Column:
    """Mean of the signals that are there: evidence (0.8 or 0.3), faithfulness, and rules (0.4 with conflicts, else 0.9)."""
    parts = F.filter(F.array(F.when(sufficient, 0.8).otherwise(0.3), faithfulness.cast("double"), F.when(conflicts.isNotNull(), F.when(conflicts, 0.4).otherwise(0.9))), lambda x: x.isNotNull())
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)


def explainability(n_steps: Column, n_assumptions: Column, n_limitations: Column) -> Column:
    part = lambda n, w: F.when(n >= 3, w).when(n >= 1, w / 2).otherwise(0.0)
    return F.least(part(n_steps, 0.4) + part(n_assumptions, 0.3) + part(n_limitations, 0.3), F.lit(1.0))


def entailment(contradiction: Column, neutral: Column, entails: Column) -> Column:
    """The share of the third of three logits, without overflow."""
    top = F.greatest(contradiction, neutral, entails)
    e = lambda c: F.exp(c - top)
    return e(entails) / (e(contradiction) + e(neutral) + e(entails))


def in_scope(best_logit: Column, judged: Column, least: float = 3.0) -> Column:
    """Whether a question is in scope: a strong hit settles it, else the judgement, which passes if it is missing."""
    return (best_logit >= least) | F.coalesce(judged, F.lit(True))


def reasoning_chain(rules: DataFrame, conflicts: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chain array<string>): what the applicable rules of a query say, step by step; rules: query_id, place, source, condition, consequence, exceptions."""
    first = rules.filter("place = 1").select("query_id", "source", "condition", "consequence", "exceptions")
    n = rules.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    j = queries.select("query_id").join(n, "query_id", "left").join(first, "query_id", "left").join(conflicts.select("query_id", F.lit(True).alias("opposed")).distinct(), "query_id", "left")
    cut = lambda c: F.concat(F.substring(c, 1, 100), F.lit("..."))
    steps = F.array(
        F.format_string("Step 1: Identified %d potentially applicable legal provisions.", "n"),
        F.concat(F.lit("Step 2: Primary applicable provision is "), "source", F.lit(". This provision states: "), cut(F.col("consequence"))),
        F.when(F.col("condition") != "", F.concat(F.lit("Step 3: This provision applies when: "), cut(F.col("condition")))),
        F.when(F.size("exceptions") > 0, F.concat(F.lit("Step 4: Note the following exceptions: "), F.array_join(F.slice("exceptions", 1, 2), "; "))),
        F.when(F.col("opposed"), "Step 5: CONFLICT DETECTED between applicable provisions.").otherwise("Step 5: No conflicts detected between applicable provisions."),
    )
    chain = F.when(F.col("n").isNull(), F.array(F.lit("No directly applicable legal rules identified from the query."))).otherwise(F.filter(steps, lambda x: x.isNotNull()))
    return j.select("query_id", chain.alias("chain"), F.coalesce("opposed", F.lit(False)).alias("abstain"))


def realigned_gold(gold: DataFrame, hits: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, key, place): the gold of a query that its hits contain, else its first hits, at most ``most``: for audits only, since
    it makes a later evaluation circular. gold: query_id, key; hits: query_id, key, rank."""
    found = hits.join(gold.withColumn("is_gold", F.lit(True)), ["query_id", "key"], "left")
    asked = found.join(gold.select("query_id").distinct(), "query_id", "left_semi")
    w = W.partitionBy("query_id")
    asked = asked.withColumn("overlap", F.count("is_gold").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc_nulls_last("is_gold"), "rank")))
    return asked.filter((F.col("overlap") == 0) & (F.col("place") <= most)).select("query_id", "key", "place")


def labelled(rows: DataFrame, label: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with unique: the label, from its second row on with its number behind it."""
    n = F.row_number().over(W.partitionBy(label).orderBy(*order))
    return rows.withColumn("n", n).withColumn("unique", F.when(F.col("n") == 1, F.col(label)).otherwise(F.concat(label, F.lit(" ("), F.col("n").cast("string"), F.lit(")")))).drop("n")


def patched(rows: DataFrame, patches: DataFrame, key: str, columns: Mapping[str, str]) -> DataFrame:
    """``rows`` with ``columns`` (own name -> name in ``patches``) replaced where a patch of their key has a value; patches have unique keys, other rows stay."""
    p = patches.select(F.col(key).alias("__key"), *[F.col(v).alias(f"__{k}") for k, v in columns.items()])
    j = rows.join(p, F.col(key) == F.col("__key"), "left")
    return j.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def patched_references(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """(item_id, passages): the lists of relevant passages with every id that ``mapping`` (old, new) has replaced, in their order."""
    e = items.select("item_id", F.xxhash64("relevant_passages").alias("h"), F.posexplode("relevant_passages").alias("no", "p")).distinct()
    j = e.join(mapping.select(F.col("old").alias("p"), "new"), "p", "left").withColumn("p", F.coalesce("new", "p"))
    return j.groupBy("item_id", "h").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "p"))), lambda x: x["p"]).alias("passages")).drop("h")


def structured_answers(answers: DataFrame, cited: DataFrame, passages: DataFrame) -> DataFrame:
    """(key columns of ``answers``, summary, law, n_excerpts): first sentences, first cited provision, and citations with a passage of exactly that act and section.

    answers: key, answer; cited: key, no, act_name, section; passages: act_name, section_number.
    """
    known = passages.select(F.col("act_name"), F.col("section_number").alias("section")).filter("section IS NOT NULL").distinct().withColumn("known", F.lit(True))
    c = cited.join(known, ["act_name", "section"], "left").groupBy("key").agg(F.min_by(F.concat("act_name", F.lit(", Section "), "section"), "no").alias("law"), F.count("known").alias("n_excerpts"))
    j = answers.join(c, "key", "left")
    return j.select("key", summary(F.col("answer")).alias("summary"), F.coalesce("law", F.lit("General legal principles")).alias("law"), F.coalesce("n_excerpts", F.lit(0)).alias("n_excerpts"))


METHODS = ("bm25", "dense", "hybrid", "hybrid_rerank")


def dispatch(method: str, has_dense: bool) -> str:
    """The method that answers a request: without vectors every method is lexical; unknown methods are errors."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}, known are {', '.join(METHODS)}")
    return method if has_dense else "bm25"
