"""Answers: statute references, reasoning steps, prompts, verdicts and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import has_any, strip

# Names of statutes by what a question may call them, and where section and statute stand in a question.
STATUTES = [("penal code", "Penal Code"), ("pc", "Penal Code"), ("civil procedure code", "Civil Procedure Code"), ("cpc", "Civil Procedure Code"), ("evidence ordinance", "Evidence Ordinance"), ("eo", "Evidence Ordinance"), ("constitution", "Constitution of Sri Lanka"), ("criminal procedure code", "Criminal Procedure Code"), ("crpc", "Criminal Procedure Code")]
SECTION_FIRST = [
    "section\\s+(\\d+[a-z]?)\\s+of\\s+(?:the\\s+)?([a-z\\s]+(?:code|ordinance|act|constitution))",
    "section\\s+(\\d+[a-z]?),\\s*([a-z\\s]+(?:code|ordinance|act))",
    "s\\.?\\s*(\\d+[a-z]?)\\s+of\\s+([a-z\\.]+)",
    "article\\s+(\\d+[a-z]?)\\s+of\\s+(?:the\\s+)?([a-z\\s]+constitution)",
]
STATUTE_FIRST = "([a-z\\s]+(?:code|ordinance|act|constitution))\\s+section\\s+(\\d+[a-z]?)"
# Words by kind of reasoning step, in order of precedence.
STEP_WORDS = [
    ("legal_rule", ["section", "act", "law", "provision", "statute"]), ("fact_analysis", ["fact", "situation", "case", "circumstance"]), ("rule_application", ["apply", "applies", "applicable"]),
    ("conclusion", ["therefore", "thus", "consequently", "conclusion"]), ("condition", ["unless", "except", "provided", "if", "condition"]),
]


def statute_name(c: Column) -> Column:
    """The known name that equals, else the first that occurs in the text, else every word capitalised."""
    s = F.lower(strip(c))
    exact = F.coalesce(*[F.when(s == k, v) for k, v in STATUTES])
    inside = F.coalesce(*[F.when(s.contains(k), v) for k, v in STATUTES])
    return F.coalesce(exact, inside, F.initcap(F.regexp_replace(s, "\\s+", " ")))


def statute_references(queries: DataFrame, compat: bool = False) -> DataFrame:
    """(query_id, section, statute, confidence), one row per section and statute with its highest confidence: 0.9 for both
    together, 0.5 for a lone section of the statute that the question names elsewhere. ``compat`` swaps both where the statute comes first."""
    q = queries.select("query_id", F.lower("query").alias("t"))
    pairs = None
    for p, first, second in [(p, "section", "statute") for p in SECTION_FIRST] + [(STATUTE_FIRST, "section", "statute") if compat else (STATUTE_FIRST, "statute", "section")]:
        z = F.arrays_zip(F.regexp_extract_all("t", F.lit(p), F.lit(1)).alias("a"), F.regexp_extract_all("t", F.lit(p), F.lit(2)).alias("b"))
        r = q.select("query_id", F.explode(z).alias("z")).select("query_id", F.col("z.a").alias(first), F.col("z.b").alias(second)).select("query_id", "section", "statute")
        pairs = r if pairs is None else pairs.unionByName(r)
    both = pairs.select("query_id", strip(F.col("section")).alias("section"), statute_name(F.col("statute")).alias("statute"), F.lit(0.9).alias("confidence"))
    named = F.coalesce(*[F.when(F.col("t").contains(k), v) for k, v in STATUTES], F.when(has_any(F.col("t"), ["theft", "murder", "assault", "criminal"]), "Penal Code"), F.when(F.col("t").contains("evidence"), "Evidence Ordinance"), F.when(has_any(F.col("t"), ["civil", "suit"]), "Civil Procedure Code"))
    lone = q.select("query_id", F.explode(F.regexp_extract_all("t", F.lit("\\bsection\\s+(\\d+[a-z]?)\\b"), F.lit(1))).alias("section"), named.alias("statute"), F.lit(0.5).alias("confidence")).filter("statute IS NOT NULL")
    return both.unionByName(lone).groupBy("query_id", "section", "statute").agg(F.max("confidence").alias("confidence"))


def step_type(c: Column) -> Column:
    out = F.lit("general")
    for name, words in reversed(STEP_WORDS):
        out = F.when(has_any(F.lower(c), words), name).otherwise(out)
    return out


def reasoning_steps(c: Column, most: int = 10) -> Column:
    """array<struct(text, source)>: numbered lines of more than 10 characters, else paragraphs of more than 20, at most ``most``."""
    lines = F.filter(F.transform(F.regexp_extract_all(c, F.lit("(?i)(?:Step\\s+)?(\\d+)[.:)\\s]+([^\\n]+)"), F.lit(2)), strip), lambda x: F.length(x) > 10)
    paragraphs = F.filter(F.transform(F.slice(F.split(c, "\\n\\n"), 1, most), strip), lambda x: F.length(x) > 20)
    tag = lambda arr, name: F.transform(F.slice(arr, 1, most), lambda x: F.struct(x.alias("text"), F.lit(name).alias("source")))
    return F.when(F.size(lines) > 0, tag(lines, "answer_text")).otherwise(tag(paragraphs, "paragraph"))


def evidence_prompt(roles: DataFrame) -> DataFrame:
    """(query_id, prompt): the primary and the supporting passages as text; a query has at most ten of them."""
    act = F.when((F.coalesce("act_name", F.lit("")) == "") | F.lower("act_name").contains("constitution"), "Constitution").otherwise(F.col("act_name"))
    label = F.when(F.col("is_article") | (act == "Constitution"), "Article").otherwise("Section")
    sec = F.coalesce("section", F.lit("[not identified]"))
    text = F.coalesce("text", F.lit(""))
    line = F.when(F.col("place") == 1, F.concat(F.lit("PRIMARY EVIDENCE:\nAct: "), act, F.lit("\n"), label, F.lit(": "), sec, F.lit("\nText: "), text, F.lit("\n"))).otherwise(
        F.concat(F.when(F.col("place") == 2, "SUPPORTING EVIDENCE:\n").otherwise(""), F.lit("\n"), (F.col("place") - 1).cast("string"), F.lit(". Act: "), act, F.lit("\n   "), label, F.lit(": "), sec, F.lit("\n   Text: "), text, F.lit("\n"))
    )
    return roles.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("prompt"))


def confidence(retrieval: Column, faithfulness: Column, citation: Column, evidence: Column, conflict: Column, weights: tuple[float, ...] = (0.25, 0.30, 0.20, 0.15, 0.10)) -> Column:
    """Weighted mean of five component scores; missing ones count as 0.5, weights are scaled to sum 1 if they do not."""
    total = sum(weights)
    scale = total if abs(total - 1) > 0.01 else 1.0
    return sum((F.coalesce(c, F.lit(0.5)) * (w / scale) for c, w in zip((retrieval, faithfulness, citation, evidence, conflict), weights)), F.lit(0.0))


def confidence_level(c: Column) -> Column:
    return F.when(c >= 0.85, "very_high").when(c >= 0.7, "high").when(c >= 0.6, "medium").when(c >= 0.4, "low").otherwise("very_low")


def penalized(rate: Column, n: Column, each: float, most: float) -> Column:
    """A rate less ``each`` per fault, ``most`` in all, at least 0."""
    return F.greatest(rate - F.least(n * each, F.lit(most)), F.lit(0.0))


# Citations with a number and its kind, and citations of a text as a whole.
NUMBERED = "\\[([^,\\]]+),\\s*(Article|Section|Chapter)?\\s*([0-9]+[A-Z]?(?:\\([0-9]+\\))?(?:\\([a-z]\\))?)\\]"
UNNUMBERED = "\\[([^,\\]]+),\\s*(Text|General)\\]"
PLAIN_SECTION = "\\[([^,]+),\\s*Section\\s+(\\d+[A-Z]?)\\]"


def _cited(answers: DataFrame, pattern: str, groups: dict[str, int], flags: str = "(?i)") -> DataFrame:
    parts = F.arrays_zip(*[F.transform(F.regexp_extract_all("answer", F.lit(flags + pattern), F.lit(g)), strip).alias(n) for n, g in groups.items()])
    keys = [c for c in answers.columns if c != "answer"]
    return answers.select(*keys, F.posexplode(parts).alias("no", "c")).select(*keys, "no", "c.*")


def typed_citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """(key columns, no, act_name, section, label, passage_id): the bracketed citations of each answer with the passage they rest on.

    answers: query_id, answer and further keys; hits: query_id, rank, passage_id, act_name, text, metadata. A numbered citation rests on
    the first hit of its act that has the number or mentions it, else on the first of its act, and stays without a passage if there is
    none; 'Text' and 'General' rest on the first hit of the act or are left out. A hit without an act fits every act.
    """
    numbered = _cited(answers, NUMBERED, {"act_name": 1, "kind": 2, "section": 3})
    whole = _cited(answers, UNNUMBERED, {"act_name": 1, "section": 2}).withColumn("kind", F.lit(""))
    keys = [c for c in answers.columns if c != "answer"]
    every = numbered.select(*keys, "no", "act_name", "section", "kind", F.lit(True).alias("numbered")).unionByName(whole.select(*keys, "no", "act_name", "section", "kind", F.lit(False).alias("numbered")))
    label = F.when(F.col("kind") != "", F.col("kind")).when(F.lower("act_name").contains("constitution"), "Article").otherwise("Section")
    every = every.withColumn("label", label).drop("kind")
    h = hits.select("query_id", "rank", "passage_id", F.lower(F.coalesce("act_name", F.lit(""))).alias("act"), F.lower(F.coalesce("text", F.lit(""))).alias("t"), F.coalesce("metadata.article_number", F.lit("")).alias("art"), F.coalesce("metadata.section_number", F.lit("")).alias("sec"))
    c, s = F.lower("act_name"), F.col("section")
    of_act = (F.col("act") == "") | F.col("act").contains(c)
    same = of_act | c.contains(F.col("act"))
    says = (F.col("art") == s) | (F.col("sec") == s)
    for form in ("article ", "section ", "chapter "):
        says = says | F.col("t").contains(F.concat(F.lit(form), s))
    j = every.join(h, "query_id", "left")
    first = lambda x: F.min(F.when(x, F.struct("rank", "passage_id")))["passage_id"]
    fit = F.coalesce(first(F.col("numbered") & same & says), first(F.when(F.col("numbered"), of_act).otherwise(same)))
    return j.groupBy(*every.columns).agg(fit.alias("passage_id")).filter(F.col("numbered") | F.col("passage_id").isNotNull())


def plain_citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """(key columns, no, act_name, section, passage_id): citations of the one form '[Act, Section n]', with the first hit of exactly that act and section."""
    c = _cited(answers, PLAIN_SECTION, {"act_name": 1, "section": 2}, "")
    h = hits.select("query_id", "rank", "passage_id", F.lower("act_name").alias("act"), F.col("metadata.section_number").alias("sec"))
    j = c.join(h, (c.query_id == h.query_id) & (F.lower(c.act_name) == h.act) & (c.section == h.sec), "left").drop(h.query_id)
    return j.groupBy(*c.columns).agg(F.min_by("passage_id", "rank").alias("passage_id"))
