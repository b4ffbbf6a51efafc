"""Queries over items, passages, answers and failures as records, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import PARSED_ABBREVIATIONS, QUESTION_STARTS, act_reference, base_id, citation_label, parsed_query, question_kind
from corpusloom.operators import answers as A
from corpusloom.operators import evidence as E
from corpusloom.operators import measures as M
from corpusloom.operators import mentions as N
from corpusloom.operators import records as R
from corpusloom.operators.answers import evidence_prompt, reasoning_steps
from corpusloom.operators.spans import citations, claims
from corpusloom.plans.analysis_queries import _FAIL, SQL as ANALYSIS_SQL
from corpusloom.plans.analysis_queries import _failures, failure_crosstab, wilcoxon_ratings
from corpusloom.plans.evidence_queries import _APP, _CON, _HB, _WS, _answers, _applicable, _hits, DISCLAIMERS, faithfulness_of, validity_of
from corpusloom.plans.evidence_queries import _ACT, _SAYS, rule_conflicts, sufficiency_of
from corpusloom.plans.evidence_queries import SQL as EVIDENCE_SQL
from corpusloom.plans.retrieval_queries import _BASE, _gold, _lexical, _passages, _queries
from corpusloom.plans.text_queries import _CITE
from corpusloom.session import materialize
from corpusloom.sources.tables import table


def act_references(spark: SparkSession, d: str) -> DataFrame:
    """Acts written as 'Name (Act No. n of yyyy)', taken apart again, and as a citation of their first section."""
    a = table(spark, d, "acts").select("act_key", "act_name", "act_year", F.concat("act_name", F.lit(" (Act No. "), "act_number", F.lit(" of "), F.col("act_year").cast("string"), F.lit(")")).alias("t"))
    r = act_reference(F.col("t"))
    return a.select("act_key", r["name"].alias("name"), r["number"].alias("number"), r["year"].alias("year"), citation_label(F.col("act_name"), F.lit("1"), F.col("act_year")).alias("label"))


def scrubbed_text(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "constitution_articles").select("article_id", "full_text").distinct()
    return t.select("article_id", F.md5("full_text").alias("text_hash"), F.md5(R.scrubbed(F.col("full_text"))).alias("scrubbed_hash"))


def extracted_text(spark: SparkSession, d: str) -> DataFrame:
    """The body of each article, or its full text where the body is short."""
    t = table(spark, d, "constitution_articles").select("article_id", "text", "full_text").distinct()
    return t.select("article_id", F.md5(R.extracted(F.col("text"), F.col("full_text"))).alias("text_hash"), (F.size(F.split(F.coalesce("full_text", F.lit("")), "\f"))).alias("n_pages"))


def _q(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d).select("query_id", "query", "query_type")


def article_topics(spark: SparkSession, d: str) -> DataFrame:
    return _q(spark, d).select("query_id", R.with_article_topics(F.col("query")).alias("retrieval_query"))


def query_traits(spark: SparkSession, d: str) -> DataFrame:
    return _q(spark, d).select("query_id", *R.traits(F.col("query")))


def filtered_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of one domain and one type."""
    i = table(spark, d, "qac_items").select("item_id", "legal_domain", "query_type").distinct()
    return R.filter_items(i, domain="criminal").select("item_id", F.lit("domain").alias("by")).unionByName(R.filter_items(i, query_type="factual").select("item_id", F.lit("type").alias("by"))).distinct()


def flagged_entries(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "audit_log").filter("flagged_for_review")
    return a.groupBy("entry_id").agg(F.min("review_reason").alias("review_reason"))


def section_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The first passage of every section of every act."""
    p = _passages(spark, d).select("corpus_pos", "act_name", "passage_id", F.col("metadata.section_number").alias("section")).filter("act_name IS NOT NULL AND section IS NOT NULL")
    return p.groupBy("act_name", "section").agg(F.min_by("passage_id", "corpus_pos").alias("passage_id"), F.min("corpus_pos").alias("corpus_pos"))


def retrieval_summary(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("query_id", "passage_id", "act_name", F.col("metadata.section_number").alias("section_number"), "score", F.lit(False).alias("exact_match"), "rank")


def item_scores(spark: SparkSession, d: str) -> DataFrame:
    """Items with the means of their complete ratings, rounded to three places; the overall mean is that of the rounded ones."""
    s = table(spark, d, "annotation_sheet").distinct().dropna(subset=[f"rag_{c}" for c in _DIMS])
    m = s.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_ratings"), *[F.round(F.avg(f"rag_{c}"), 3).alias(c) for c in _DIMS])
    m = m.withColumn("overall", F.round((F.col("correctness") + F.col("completeness") + F.col("clarity")) / 3, 3))
    items = table(spark, d, "qac_items").select("item_id").distinct()
    return items.join(m, "item_id", "left").select("item_id", F.coalesce("n_ratings", F.lit(0)).alias("n_ratings"), *_DIMS, "overall")


def severe_failures(spark: SparkSession, d: str) -> DataFrame:
    """Runs and items with failures of at least medium severity, with the place of the severity, worst first."""
    f = _failures(spark, d).filter(R.at_least(F.col("severity"), "medium"))
    return f.select("run_id", "query_id", "severity", R.severity_order(F.col("severity")).alias("priority"))


def failure_examples(spark: SparkSession, d: str) -> DataFrame:
    """Three items per failure mode."""
    f = _failures(spark, d).select("query_id", F.explode("modes").alias("mode")).filter("mode <> 'no_failure'").distinct()
    return R.examples(f, ["mode"], ["query_id"]).select("mode", "place", "query_id")


def run_faithfulness(spark: SparkSession, d: str) -> DataFrame:
    return faithfulness_of(_answers(spark, d), _hits(spark, d))


def run_citation_validity(spark: SparkSession, d: str) -> DataFrame:
    return validity_of(_answers(spark, d), _hits(spark, d))


def run_failure_modes(spark: SparkSession, d: str) -> DataFrame:
    return _failures(spark, d).select("run_id", "query_id", F.array_join("modes", "|").alias("modes"), "severity")


def run_failure_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return failure_crosstab(spark, d)


def scope_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether each question is in scope, with a synthetic logit and a synthetic judgement that is missing for every third number."""
    h = _lexical(spark, d).groupBy("query_id").agg(F.max(((F.col("corpus_pos") * 37) % 200) / 20.0 - 6.0).alias("best"))
    n = F.length("query_id") + F.length("query")
    judged = F.when(n % 3 != 0, n % 3 == 1)
    return _q(spark, d).join(h, "query_id").select("query_id", R.in_scope(F.col("best"), judged).alias("in_scope"))


def reasoning_chains(spark: SparkSession, d: str) -> DataFrame:
    r = _applicable(spark, d).select("query_id", "place", F.concat_ws(", ", F.coalesce("act_name", F.lit("Unknown")), F.coalesce("metadata.section_number", F.lit("Unknown"))).alias("source"), "condition", "consequence", "exceptions")
    c = R.reasoning_chain(r, rule_conflicts(spark, d), _q(spark, d))
    return c.select("query_id", F.size("chain").alias("n_steps"), F.md5(F.array_join("chain", "\n")).alias("chain_hash"), "abstain")


def entailed_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims of the gold answers, supported by synthetic entailment logits or, below 0.3, by containment."""
    g = table(spark, d, "qac_items").select(F.col("item_id").alias("query_id"), F.posexplode("gold_answers").alias("a", "g")).select("query_id", "a", F.posexplode(claims(F.col("g.answer_text"))).alias("k", "claim")).select("query_id", (F.col("a") * 1000 + F.col("k")).alias("no"), "claim").distinct()
    logit = lambda k: ((F.col("corpus_pos") * k + F.col("rank") * 7) % 100) / 20.0 - 2.5
    h = _hits(spark, d).withColumn("p", R.entailment(logit(13), logit(29), logit(41)))
    s = E.claim_support(g, h, nli="p")
    return s.select("query_id", "no", F.round("nli", 6).alias("nli"), "supported")


def document_claims(spark: SparkSession, d: str) -> DataFrame:
    """Statements that an article is in an act, one per passage with an article number, against the passages of the same chapter."""
    p = _passages(spark, d).select("corpus_pos", "passage_id", "act_name", "metadata").filter("metadata.article_number IS NOT NULL")
    c = p.select(F.col("corpus_pos").cast("string").alias("query_id"), F.lit(0).alias("no"), F.concat(F.lit("Article "), "metadata.article_number", F.lit(" is in the Constitution")).alias("claim"))
    h = p.select(F.col("corpus_pos").cast("string").alias("query_id"), F.lit(1).alias("rank"), "passage_id", "act_name", "metadata")
    return E.document_facts(c, h).select("query_id", "passage_id")


def simple_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of a question from its evidence, the mean faithfulness of its runs and its rule conflicts."""
    lexical = materialize(_lexical(spark, d))  # one search for all three
    f = faithfulness_of(_answers(spark, d), lexical.join(_passages(spark, d), "corpus_pos")).groupBy("query_id").agg(F.avg("faithfulness").alias("faith"))
    c = E.rule_conflicts(_applicable(spark, d, lexical)).select("query_id", F.lit(True).alias("opposed")).distinct()
    j = sufficiency_of(spark, d, lexical).join(f, "query_id", "left").join(c, "query_id", "left")
    return j.select("query_id", F.round(R.simple_confidence(F.col("gate") == "sufficient", F.col("faith"), F.coalesce("opposed", F.lit(False))), 4).alias("confidence"))


def explainability(spark: SparkSession, d: str) -> DataFrame:
    """Score of each audited answer: reasoning steps, stated conditions as assumptions, and reservations as limitations."""
    a = table(spark, d, "audit_log").filter("answer IS NOT NULL").select("entry_id", "answer").distinct()
    low = F.lower("answer")
    return a.select("entry_id", F.md5("answer").alias("answer_hash"), F.round(R.explainability(F.size(reasoning_steps(F.col("answer"))), F.regexp_count(low, F.lit("if|unless|provided")), F.regexp_count(low, F.lit("may|general|however"))), 4).alias("score"))


def key_concepts(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "audit_log").filter("answer IS NOT NULL").select("entry_id", "answer").distinct()
    labels = F.transform(citations(F.col("answer")), lambda c: F.concat(c["act_name"], F.lit(", Section "), c["section"]))
    return a.select("entry_id", F.md5("answer").alias("answer_hash"), F.array_join(F.transform(R.key_concepts(F.col("answer"), labels), lambda x: x["concept"]), "|").alias("concepts"))


def citation_ratio(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "audit_log").select("entry_id", F.size("citations").alias("n"), "num_passages").distinct()
    n = F.greatest(F.coalesce("n", F.lit(0)), F.lit(0))
    return a.select("entry_id", n.alias("num_citations"), F.round(F.when(F.col("num_passages") > 0, n / F.col("num_passages")).otherwise(0.0), 6).alias("ratio")).distinct()


def rating_significance(spark: SparkSession, d: str) -> DataFrame:
    """Two-sided probability of the signed-rank test per dimension, by the normal approximation, times the number of tests and at most 1."""
    w = wilcoxon_ratings(spark, d)
    p = M.normal_tail(F.col("z"))
    return w.select("dimension", "n", "z", F.round(p, 6).alias("p"), F.round(F.least(p * 3, F.lit(1.0)), 6).alias("p_corrected"))


def gold_realigned(spark: SparkSession, d: str) -> DataFrame:
    h = _lexical(spark, d).filter("rank <= 10").join(_passages(spark, d).select("corpus_pos", "passage_id"), "corpus_pos").groupBy("query_id", F.col("passage_id").alias("key")).agg(F.min("rank").alias("rank"))
    g = table(spark, d, "qac_items").select(F.col("item_id").alias("query_id"), F.explode("relevant_passages").alias("key")).filter("key IS NOT NULL").distinct()
    return R.realigned_gold(g, h)


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "audit_log")
    cols = ("entry_type", "query_type", "retrieval_method", "user_id", "review_reason", "error_type")
    long = a.select(F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("v")) for c in cols])).alias("x")).select("x.*")
    return long.groupBy("label").agg(F.count_distinct("v").alias("n_values"), F.count("v").alias("n_rows"))


def unique_labels(spark: SparkSession, d: str) -> DataFrame:
    """Names of acts, repeated ones with their number."""
    return R.labelled(table(spark, d, "acts").filter("act_name IS NOT NULL").select("act_key", "act_name"), "act_name", ["act_key"]).select("act_key", F.col("unique").alias("label"))


def registered_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of registered acts, with the number of acts registered under their number and year; sections of unknown acts are left out."""
    a = table(spark, d, "acts").select(F.col("act_number").alias("n"), F.col("act_year").alias("y"), "act_key").filter("n IS NOT NULL AND y IS NOT NULL")
    a = a.groupBy("n", "y").agg(F.count_distinct("act_key").alias("n_acts"))
    s = table(spark, d, "legal_sections").select("section_id", F.col("act_number").cast("string").alias("n"), F.col("act_year").alias("y")).distinct()
    return s.join(a, ["n", "y"]).select("section_id", "n_acts")


def annotation_template(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "qac_items").select("item_id", "question", "query_type").distinct()
    return i.select("item_id", "question", "query_type", *[F.lit(None).cast("string").alias(c) for c in ("answer", "annotator_id", "notes")])


def proofread_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The sections with the text of their proofreader where there is one."""
    s = table(spark, d, "legal_sections").select("section_id", "text").distinct()
    p = table(spark, d, "proofread_samples").filter("record_type = 'section'").groupBy(F.col("record_id").alias("section_id")).agg(F.min("clean_text").alias("clean_text"))
    return R.patched(s, p, "section_id", {"text": "clean_text"}).select("section_id", F.md5("text").alias("text_hash")).distinct()


def repointed_items(spark: SparkSession, d: str) -> DataFrame:
    """Relevant passages with the ids of chunks replaced by those of their sections where such a passage exists."""
    p = _passages(spark, d).select("passage_id").filter("passage_id IS NOT NULL").distinct()
    m = p.select(F.col("passage_id").alias("old"), base_id(F.col("passage_id")).alias("new")).filter("old <> new").join(p.withColumnRenamed("passage_id", "new"), "new", "left_semi")
    return R.patched_references(table(spark, d, "qac_items").select("item_id", "relevant_passages"), m).select("item_id", F.array_join("passages", "|").alias("passages"))


def structured_answers(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "audit_log").filter("answer IS NOT NULL").select(F.concat_ws("|", "entry_id", F.md5("answer")).alias("key"), "answer").distinct()
    c = a.select("key", F.posexplode(citations(F.col("answer"))).alias("no", "c")).select("key", "no", "c.act_name", "c.section")
    p = _passages(spark, d).select("act_name", F.col("metadata.section_number").alias("section_number"))
    return R.structured_answers(a, c, p).select("key", F.md5("summary").alias("summary_hash"), "law", "n_excerpts")


def unused_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages that no item refers to: what a dataset can be extended by."""
    used = table(spark, d, "qac_items").select(F.explode("relevant_passages").alias("passage_id")).distinct()
    return _passages(spark, d).select("corpus_pos", "passage_id").filter("passage_id IS NOT NULL").join(used, "passage_id", "left_anti").select("corpus_pos", "passage_id")


def mention_list(spark: SparkSession, d: str) -> DataFrame:
    """Every kind of mention of the sections with its targets and how often they are named; amending acts count once a text."""
    s = table(spark, d, "legal_sections").select("section_id", "text").groupBy("section_id").agg(F.min("text").alias("text"))
    return N.mentions(s, "section_id").groupBy("section_id", "kind", "target").agg(F.count(F.lit(1)).alias("n"))


def prompt_hash(spark: SparkSession, d: str) -> DataFrame:
    p = evidence_prompt(E.primary_and_supporting(E.confidence_filter(_hits(spark, d), 0.3)))
    return p.select("query_id", F.md5("prompt").alias("prompt_hash"))


def parsed_queries(spark: SparkSession, d: str) -> DataFrame:
    return _q(spark, d).select("query_id", parsed_query(F.col("query")).alias("parsed"), question_kind(F.col("query")).alias("kind"))


def typed_citations(spark: SparkSession, d: str) -> DataFrame:
    return A.typed_citations(_answers(spark, d), _hits(spark, d)).select("run_id", "query_id", "no", "act_name", "section", "label", "passage_id")


def plain_citations(spark: SparkSession, d: str) -> DataFrame:
    return A.plain_citations(_answers(spark, d), _hits(spark, d)).select("run_id", "query_id", "no", "act_name", "section", "passage_id")


def dispatched_methods(spark: SparkSession, d: str) -> DataFrame:
    """The method that answers each request of the audit log while there are vectors and while there are none; unknown methods are left out."""
    m = table(spark, d, "audit_log").select("retrieval_method").distinct().filter(F.col("retrieval_method").isin(list(R.METHODS)))
    use = lambda dense: F.element_at(F.create_map(*[F.lit(x) for k in R.METHODS for x in (k, R.dispatch(k, dense))]), F.col("retrieval_method"))
    return m.select("retrieval_method", use(True).alias("with_vectors"), use(False).alias("without_vectors"))


QUERIES = {
    f.__name__: f
    for f in (
        act_references, scrubbed_text, extracted_text, article_topics, query_traits, filtered_items, flagged_entries, section_lookup, retrieval_summary, item_scores, severe_failures, failure_examples,
        run_faithfulness, run_citation_validity, run_failure_modes, run_failure_crosstab, scope_gate, reasoning_chains, entailed_claims, document_claims, simple_confidence, explainability, key_concepts, citation_ratio,
        rating_significance, gold_realigned, label_counts, unique_labels, registered_sections, annotation_template, proofread_corpus, repointed_items, structured_answers, unused_passages, mention_list, prompt_hash, parsed_queries, typed_citations, plain_citations, dispatched_methods,
    )
}

_DIMS = ("correctness", "completeness", "clarity")
_RUNS = ", ans AS (SELECT DISTINCT run_id, item_id AS query_id, rag_answer AS answer FROM annotation_sheet WHERE rag_answer IS NOT NULL)"
_GOLD_CLAIMS = f"""c0 AS (SELECT item_id AS query_id, gold_answers AS g FROM qac_items), c1 AS (SELECT query_id, unnest(range(len(g))) AS a, unnest(g) AS g FROM c0),
  c2 AS (SELECT query_id, a, list_filter(list_transform(string_split_regex(regexp_replace(g.answer_text, '\\[.*?\\]', '', 'g'), '[.!?]+'), lambda s: regexp_replace(s, '^{_WS}+|{_WS}+$', '', 'g')), lambda s: length(s) > 10 AND NOT regexp_matches(lower(s), '{'|'.join(DISCLAIMERS)}')) AS c FROM c1),
  c3 AS (SELECT DISTINCT query_id, (a * 1000 + k)::INT AS no, claim FROM (SELECT query_id, a, unnest(range(len(c))) AS k, unnest(c) AS claim FROM c2))"""
_FAITH = _HB + _RUNS + f""", cl AS (SELECT run_id, query_id, unnest(range(len(c))) AS no, unnest(c) AS claim FROM (SELECT run_id, query_id, list_filter(list_transform(string_split_regex(regexp_replace(answer, '\\[.*?\\]', '', 'g'), '[.!?]+'), lambda s: regexp_replace(s, '^{_WS}+|{_WS}+$', '', 'g')), lambda s: length(s) > 10 AND NOT regexp_matches(lower(s), '{'|'.join(DISCLAIMERS)}')) AS c FROM ans)),
  su AS (SELECT run_id, query_id, no, claim, max({_CON}) >= 0.4 AS supported FROM cl LEFT JOIN hp USING (query_id) GROUP BY 1, 2, 3, 4),
  rf AS (SELECT run_id, query_id, count(*) AS n_claims, count(*) FILTER (supported) AS n_supported, round(count(*) FILTER (supported) / count(*), 6) AS faithfulness, count(*) FILTER (supported) / count(*) >= 0.8 AS is_faithful FROM su GROUP BY 1, 2)"""
_RFAIL = _FAIL.replace("fl AS (SELECT item_id AS query_id, arg_min_null(rag_abstained, {'a': run_id, 'b': rag_abstained}) AS abstained, arg_min_null(rag_attribution_f1, {'a': run_id, 'b': rag_abstained}) AS support FROM (SELECT DISTINCT * FROM annotation_sheet) GROUP BY 1)", "fl AS (SELECT DISTINCT run_id, item_id AS query_id, rag_abstained AS abstained, rag_attribution_f1 AS support FROM annotation_sheet)").replace("fj AS (SELECT query_id, query_type,", "fj AS (SELECT run_id, query_id, query_type,")
_SEV = "CASE WHEN list_contains(modes, 'faithfulness_failure') THEN 'critical' WHEN list_has_any(modes, ['retrieval_miss', 'missed_abstention']) THEN 'high' WHEN list_has_any(modes, ['wrong_abstention', 'coverage_failure']) THEN 'medium' WHEN list_contains(modes, 'partial_retrieval') THEN 'low' ELSE 'none' END"
_TRIM = f"regexp_replace({{c}}, '^{_WS}+|{_WS}+$', '', 'g')"


def _sub(c: str, pattern: str, by: str) -> str:
    flags = "gi" if pattern.startswith("(?i)") else "g"
    text = pattern.removeprefix("(?i)").replace("\\n", "\n").replace("\\s", _WS)
    new = by.replace("$1", "\\1").replace("$2", "\\2")
    return f"regexp_replace({c}, '{text}', '{new}', '{flags}')"


_SCRUB = "full_text"
for _p, _b in R.ARTEFACTS:
    _SCRUB = _sub(_SCRUB, _p, _b)
_SCRUB = _TRIM.format(c=_SCRUB)
_ANY = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
_CITED = f"SELECT key, no, trim(a) AS act_name, trim(s) AS section FROM (SELECT key, unnest(range(len(regexp_extract_all(answer, '{_CITE}', 1, 'i')))) AS no, unnest(regexp_extract_all(answer, '{_CITE}', 1, 'i')) AS a, unnest(regexp_extract_all(answer, '{_CITE}', 2, 'i')) AS s FROM a)"
_TERMS = ", ".join(f"CASE WHEN contains(lower(answer), '{t}') THEN '{t.capitalize()}' END" for t in R.CONCEPT_TERMS)
_STEPS = f"""CASE WHEN len(list_filter(list_transform(regexp_extract_all(answer, '(?:Step\\s+)?(\\d+)[.:)\\s]+([^\\n]+)', 2, 'i'), lambda x: {_TRIM.format(c='x')}), lambda x: length(x) > 10)) > 0
  THEN least(10, len(list_filter(list_transform(regexp_extract_all(answer, '(?:Step\\s+)?(\\d+)[.:)\\s]+([^\\n]+)', 2, 'i'), lambda x: {_TRIM.format(c='x')}), lambda x: length(x) > 10)))
  ELSE len(list_filter(list_transform(string_split(answer, chr(10) || chr(10))[1:10], lambda x: {_TRIM.format(c='x')}), lambda x: length(x) > 20)) END"""
_TAIL = "((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x)"
_GATE = EVIDENCE_SQL["sufficiency"]
_LOGIT = "(((corpus_pos * {k} + rank * 7) % 100) / 20.0 - 2.5)"
_E = {k: f"exp({_LOGIT.format(k=k)} - greatest({', '.join(_LOGIT.format(k=j) for j in (13, 29, 41))}))" for k in (13, 29, 41)}
_SECT = "section\\s+(\\d+[A-Z]?(?:\\([a-z0-9]+\\))?)"
_ACTNO = "Act No\\.\\s*(\\d+)\\s+of\\s+(\\d{4})"
_TOPIC = "CASE n " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.ARTICLE_TOPICS.items()) + " END"
_P3E = """p1 AS (SELECT *, row_number() OVER w AS pl, first_value(passage_id) OVER w AS pid FROM cf WINDOW w AS (PARTITION BY query_id ORDER BY coalesce(normalized_score, score) DESC, rank)),
  p2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(normalized_score, score) DESC, rank)::INT AS place FROM p1 WHERE pl = 1 OR passage_id <> pid)"""
_VALID = "regexp_full_match(trim({c}), '[0-9]+[A-Z]?(\\([0-9]+\\))?(\\([a-z]\\))?')"
_PARSED = f"regexp_replace(regexp_replace(lower(query), '{_WS}+', ' ', 'g'), '^{_WS}+|{_WS}+$', '', 'g')"
for _a, _b in PARSED_ABBREVIATIONS:
    _PARSED = f"replace({_PARSED}, '{_a}', '{_b}')"
_KIND = "CASE " + " ".join(f"WHEN {' OR '.join(f'starts_with(lower(query), {x!r})' for x in xs)} THEN '{k}'" for k, xs in QUESTION_STARTS) + " ELSE 'general' END"


def _all(pattern: str, names: dict[str, int], flags: str = "i") -> str:
    got = {n: f"regexp_extract_all(answer, '{pattern}', {g}, '{flags}')" for n, g in names.items()}
    return f"SELECT run_id, query_id, unnest(range(len({next(iter(got.values()))})))::INT AS no, " + ", ".join(f"unnest(list_transform({x}, lambda y: {_TRIM.format(c='y')})) AS {n}" for n, x in got.items()) + " FROM ans"


SQL = {
    "parsed_queries": _BASE + f"SELECT query_id, {_PARSED} AS parsed, {_KIND} AS kind FROM q",
    "typed_citations": _HB + _RUNS + f""", nu AS ({_all(A.NUMBERED, {'act_name': 1, 'kind': 2, 'section': 3})}), un AS ({_all(A.UNNUMBERED, {'act_name': 1, 'section': 2})}),
      ev AS (SELECT run_id, query_id, no, act_name, section, kind, true AS numbered FROM nu UNION ALL SELECT run_id, query_id, no, act_name, section, '', false FROM un),
      ho AS (SELECT query_id, rank, passage_id, lower(coalesce(act_name, '')) AS act, lower(coalesce(text, '')) AS t, coalesce(metadata.article_number, '') AS art, coalesce(metadata.section_number, '') AS sec FROM hp),
      jo AS (SELECT ev.*, rank, passage_id, act = '' OR contains(act, lower(act_name)) AS ofact, contains(lower(act_name), act) AS within, art = section OR sec = section OR contains(t, 'article ' || section) OR contains(t, 'section ' || section) OR contains(t, 'chapter ' || section) AS says FROM ev LEFT JOIN ho USING (query_id)),
      fi AS (SELECT run_id, query_id, no, act_name, section, kind, numbered, coalesce(arg_min(passage_id, rank) FILTER (numbered AND (ofact OR within) AND says), arg_min(passage_id, rank) FILTER (ofact OR (NOT numbered AND within))) AS passage_id FROM jo GROUP BY 1, 2, 3, 4, 5, 6, 7)
      SELECT run_id, query_id, no, act_name, section, CASE WHEN kind <> '' THEN kind WHEN contains(lower(act_name), 'constitution') THEN 'Article' ELSE 'Section' END AS label, passage_id FROM fi WHERE numbered OR passage_id IS NOT NULL""",
    "plain_citations": _HB + _RUNS + f""", ci AS ({_all(A.PLAIN_SECTION, {'act_name': 1, 'section': 2}, 'c')}) SELECT c.run_id, c.query_id, c.no, c.act_name, c.section, arg_min(h.passage_id, h.rank) AS passage_id FROM ci c LEFT JOIN hp h ON c.query_id = h.query_id AND lower(c.act_name) = lower(h.act_name) AND c.section = h.metadata.section_number GROUP BY 1, 2, 3, 4, 5""",
    "act_references": """SELECT act_key, CASE WHEN ok THEN trim(regexp_extract(t, '([^(]+)\\s*\\(Act\\s+No\\.\\s*(\\d+)\\s+of\\s+(\\d{4})\\)', 1)) END AS name, CASE WHEN ok THEN regexp_extract(t, '([^(]+)\\s*\\(Act\\s+No\\.\\s*(\\d+)\\s+of\\s+(\\d{4})\\)', 2) END AS number, CASE WHEN ok THEN regexp_extract(t, '([^(]+)\\s*\\(Act\\s+No\\.\\s*(\\d+)\\s+of\\s+(\\d{4})\\)', 3) END AS year,
      act_name || ', Section 1' || CASE WHEN coalesce(act_year, 0) <> 0 THEN ' (' || act_year || ')' ELSE '' END AS label FROM (SELECT *, regexp_matches(t, '([^(]+)\\s*\\(Act\\s+No\\.\\s*(\\d+)\\s+of\\s+(\\d{4})\\)') AS ok FROM (SELECT *, CASE WHEN act_name IS NULL OR act_number IS NULL OR act_year IS NULL THEN NULL ELSE act_name || ' (Act No. ' || act_number || ' of ' || act_year || ')' END AS t FROM acts))""",
    "scrubbed_text": f"SELECT DISTINCT article_id, md5(full_text) AS text_hash, md5({_SCRUB}) AS scrubbed_hash FROM constitution_articles",
    "extracted_text": f"SELECT article_id, md5(CASE WHEN length({_TRIM.format(c='text')}) > 100 THEN text ELSE full_text END) AS text_hash, len(string_split(coalesce(full_text, ''), chr(12)))::INT AS n_pages FROM (SELECT DISTINCT article_id, text, full_text FROM constitution_articles)",
    "article_topics": _BASE + f"SELECT query_id, CASE WHEN len(t) > 0 THEN query || ' ' || array_to_string(t, ' ') ELSE query END AS retrieval_query FROM (SELECT query_id, query, list_filter(list_transform(regexp_extract_all(query, '\\bArticle\\s+(\\d+[A-Z]?)\\b', 1, 'i'), lambda n: {_TOPIC}), lambda x: x IS NOT NULL) AS t FROM q)",
    "query_traits": _BASE + f"SELECT query_id, {_ANY('lower(query)', R.COMPARISON)} AS has_comparison, {_ANY('lower(query)', R.TEMPORAL)} AS has_temporal, {_ANY('lower(query)', R.QUANTITY)} AS has_quantifier, CASE WHEN n < 10 THEN 'easy' WHEN n > 25 OR contains(lower(query), 'interpret') THEN 'hard' ELSE 'medium' END AS difficulty FROM (SELECT *, len(string_split_regex({_TRIM.format(c='query')}, '{_WS}+')) AS n FROM q)",
    "filtered_items": "SELECT DISTINCT item_id, 'domain' AS by FROM qac_items WHERE legal_domain = 'criminal' UNION SELECT DISTINCT item_id, 'type' FROM qac_items WHERE query_type = 'factual'",
    "flagged_entries": "SELECT entry_id, min(review_reason) AS review_reason FROM audit_log WHERE flagged_for_review GROUP BY 1",
    "section_lookup": "SELECT act_name, metadata.section_number AS section, arg_min(passage_id, corpus_pos) AS passage_id, min(corpus_pos) AS corpus_pos FROM passages WHERE act_name IS NOT NULL AND metadata.section_number IS NOT NULL GROUP BY 1, 2",
    "retrieval_summary": _HB + "SELECT query_id, passage_id, act_name, metadata.section_number AS section_number, score, false AS exact_match, rank FROM hp",
    "item_scores": f"""SELECT item_id, coalesce(n_ratings, 0) AS n_ratings, correctness, completeness, clarity, round((correctness + completeness + clarity) / 3, 3) AS overall FROM (SELECT DISTINCT item_id FROM qac_items) LEFT JOIN (
      SELECT item_id, count(*) AS n_ratings, {', '.join(f'round(avg(rag_{c}), 3) AS {c}' for c in _DIMS)} FROM (SELECT DISTINCT * FROM annotation_sheet) WHERE {' AND '.join(f'rag_{c} IS NOT NULL' for c in _DIMS)} GROUP BY 1) USING (item_id)""",
    "severe_failures": _RFAIL + f"SELECT run_id, query_id, severity, (list_position({R.SEVERITIES!r}, severity) - 1)::INT AS priority FROM (SELECT *, {_SEV} AS severity FROM fm) WHERE severity IN ('critical', 'high', 'medium')",
    "failure_examples": _RFAIL + "SELECT mode, place, query_id FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY query_id)::INT AS place FROM (SELECT DISTINCT query_id, unnest(modes) AS mode FROM fm) WHERE mode <> 'no_failure') WHERE place <= 3",
    "run_faithfulness": _FAITH + " SELECT * FROM rf",
    "run_citation_validity": _HB + _RUNS + f""", ci AS (SELECT run_id, query_id, no, trim(a) AS act_name, trim(s) AS section FROM (SELECT run_id, query_id, unnest(range(len(regexp_extract_all(answer, '{_CITE}', 1, 'i')))) AS no, unnest(regexp_extract_all(answer, '{_CITE}', 1, 'i')) AS a, unnest(regexp_extract_all(answer, '{_CITE}', 2, 'i')) AS s FROM ans)),
      cv AS (SELECT c.run_id, c.query_id, c.no, c.act_name, c.section, coalesce(bool_or({_ACT}), false) AS v, coalesce(bool_or({_ACT} AND {_SAYS}), false) AS st FROM ci c LEFT JOIN hp h USING (query_id) GROUP BY 1, 2, 3, 4, 5)
      SELECT run_id, query_id, count(*) AS n_citations, count(*) FILTER (v) AS n_valid, count(*) FILTER (st) AS n_strict FROM cv GROUP BY 1, 2""",
    "run_failure_modes": _RFAIL + f"SELECT run_id, query_id, array_to_string(modes, '|') AS modes, {_SEV} AS severity FROM fm",
    "run_failure_crosstab": _RFAIL + "SELECT c.query_type, mode, n, round(n / n_items, 4) AS rate FROM (SELECT query_type, mode, count(*) AS n FROM (SELECT query_type, unnest(modes) AS mode FROM fm) GROUP BY 1, 2) c JOIN (SELECT query_type, count(*) AS n_items FROM fm GROUP BY 1) i ON c.query_type IS NOT DISTINCT FROM i.query_type",
    "scope_gate": _BASE + "SELECT query_id, best >= 3.0 OR CASE WHEN n % 3 = 0 THEN true ELSE n % 3 = 1 END AS in_scope FROM (SELECT query_id, max(length(query_id) + length(query)) AS n, max(((corpus_pos * 37) % 200) / 20.0 - 6.0) AS best FROM hits JOIN q USING (query_id) GROUP BY 1)",
    "reasoning_chains": _HB + _APP + f""", fr AS (SELECT query_id, concat_ws(', ', coalesce(act_name, 'Unknown'), coalesce(metadata.section_number, 'Unknown')) AS source, condition, consequence,
        list_filter([{', '.join(f'''CASE WHEN contains(lower(text), '{w}') THEN trim(string_split(substring(text, strpos(lower(text), '{w}')::INT, 150), '.')[1], ' ') END''' for w in E.EXCEPTIONS)}], lambda x: x IS NOT NULL) AS ex FROM ap WHERE place = 1),
      cn AS (SELECT query_id, count(*) AS n FROM ap GROUP BY 1), oc AS (SELECT DISTINCT query_id FROM ({EVIDENCE_SQL['rule_conflicts'][len(_HB) + len(_APP):]})),
      ch AS (SELECT q.query_id, oc.query_id IS NOT NULL AS opposed, CASE WHEN n IS NULL THEN ['No directly applicable legal rules identified from the query.'] ELSE list_filter(['Step 1: Identified ' || n || ' potentially applicable legal provisions.',
        'Step 2: Primary applicable provision is ' || source || '. This provision states: ' || left(consequence, 100) || '...', CASE WHEN condition <> '' THEN 'Step 3: This provision applies when: ' || left(condition, 100) || '...' END,
        CASE WHEN len(ex) > 0 THEN 'Step 4: Note the following exceptions: ' || array_to_string(ex[1:2], '; ') END, CASE WHEN oc.query_id IS NOT NULL THEN 'Step 5: CONFLICT DETECTED between applicable provisions.' ELSE 'Step 5: No conflicts detected between applicable provisions.' END], lambda x: x IS NOT NULL) END AS c
        FROM q LEFT JOIN cn ON q.query_id = cn.query_id LEFT JOIN fr ON q.query_id = fr.query_id LEFT JOIN oc ON q.query_id = oc.query_id)
      SELECT query_id, len(c)::INT AS n_steps, md5(array_to_string(c, chr(10))) AS chain_hash, opposed AS abstain FROM ch""",
    "entailed_claims": _HB + f""", {_GOLD_CLAIMS}, pr AS (SELECT *, {_E[41]} / ({_E[13]} + {_E[29]} + {_E[41]}) AS p FROM hp)
      SELECT query_id, no, round(max(p), 6) AS nli, coalesce(max(p), 0) >= 0.3 OR max(CASE WHEN coalesce(p, 0) < 0.3 THEN {_CON} ELSE 0.0 END) >= 0.4 AS supported FROM c3 LEFT JOIN pr USING (query_id) GROUP BY query_id, no, claim""",
    "document_claims": """SELECT corpus_pos::VARCHAR AS query_id, passage_id FROM passages WHERE (coalesce(act_name, '') = '' OR contains(lower(act_name), 'constitution')) AND regexp_matches(lower('Article ' || metadata.article_number || ' is in the Constitution'), 'article\\s+(\\d+[a-z]?(?:\\([0-9]+\\))?(?:\\([a-z]\\))?)\\s+is\\s+(?:in|contained\\s+in)\\s+([^,.]+)')""",
    "simple_confidence": f"WITH g AS ({_GATE}), f AS (SELECT query_id, avg(faithfulness) AS faith FROM ({_FAITH} SELECT * FROM rf) GROUP BY 1), c AS (SELECT DISTINCT query_id AS o FROM ({EVIDENCE_SQL['rule_conflicts']})) SELECT query_id, round((CASE WHEN gate = 'sufficient' THEN 0.8 ELSE 0.3 END + coalesce(faith, 0) + CASE WHEN o IS NULL THEN 0.9 ELSE 0.4 END) / CASE WHEN faith IS NULL THEN 2 ELSE 3 END, 4) AS confidence FROM g LEFT JOIN f USING (query_id) LEFT JOIN c ON g.query_id = c.o",
    "explainability": f"""SELECT entry_id, md5(answer) AS answer_hash, round(CASE WHEN s >= 3 THEN 0.4 WHEN s >= 1 THEN 0.2 ELSE 0 END + CASE WHEN a >= 3 THEN 0.3 WHEN a >= 1 THEN 0.15 ELSE 0 END + CASE WHEN l >= 3 THEN 0.3 WHEN l >= 1 THEN 0.15 ELSE 0 END, 4)::DOUBLE AS score FROM (
      SELECT entry_id, answer, {_STEPS} AS s, len(regexp_extract_all(lower(answer), 'if|unless|provided')) AS a, len(regexp_extract_all(lower(answer), 'may|general|however')) AS l FROM (SELECT DISTINCT entry_id, answer FROM audit_log WHERE answer IS NOT NULL))""",
    "key_concepts": f"""SELECT entry_id, md5(answer) AS answer_hash, array_to_string(list_transform(list_filter(list_transform(range(1, len(c) + 1), lambda i: {{'i': i, 'x': c[i]}}), lambda y: list_position(list_transform(c, lambda z: lower(z)), lower(y.x)) = y.i)[1:10], lambda y: y.x), '|') AS concepts FROM (
      SELECT entry_id, answer, list_concat(list_transform(range(1, len(regexp_extract_all(answer, '{_CITE}', 1, 'i')) + 1), lambda i: trim(regexp_extract_all(answer, '{_CITE}', 1, 'i')[i]) || ', Section ' || trim(regexp_extract_all(answer, '{_CITE}', 2, 'i')[i])), list_filter([{_TERMS}], lambda x: x IS NOT NULL)) AS c FROM (SELECT DISTINCT entry_id, answer FROM audit_log WHERE answer IS NOT NULL))""",
    "citation_ratio": "SELECT DISTINCT entry_id, coalesce(len(citations), 0)::INT AS num_citations, round(CASE WHEN num_passages > 0 THEN coalesce(len(citations), 0) / num_passages ELSE 0.0 END, 6) AS ratio FROM audit_log",
    "rating_significance": f"SELECT dimension, n, z, round(p, 6) AS p, round(least(p * 3, 1.0), 6) AS p_corrected FROM (SELECT *, {_TAIL} AS p FROM (SELECT *, 1 / (1 + 0.3275911 * x) AS t FROM (SELECT *, abs(z) / sqrt(2) AS x FROM ({ANALYSIS_SQL['wilcoxon_ratings']}))))",
    "gold_realigned": _HB + """, gp AS (SELECT DISTINCT query_id, key FROM (SELECT item_id AS query_id, unnest(relevant_passages) AS key FROM qac_items) WHERE key IS NOT NULL), hk AS (SELECT query_id, passage_id AS key, min(rank) AS rank FROM hp WHERE rank <= 10 GROUP BY 1, 2)
      SELECT query_id, key, place FROM (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS place FROM hk WHERE query_id IN (SELECT query_id FROM gp) AND query_id NOT IN (SELECT query_id FROM gp JOIN hk USING (query_id, key))) WHERE place <= 3""",
    "label_counts": " UNION ALL ".join(f"SELECT '{c}' AS label, count(DISTINCT {c}) AS n_values, count({c}) AS n_rows FROM audit_log" for c in ("entry_type", "query_type", "retrieval_method", "user_id", "review_reason", "error_type")),
    "unique_labels": "SELECT act_key, CASE WHEN n = 1 THEN act_name ELSE act_name || ' (' || n || ')' END AS label FROM (SELECT *, row_number() OVER (PARTITION BY act_name ORDER BY act_key) AS n FROM acts WHERE act_name IS NOT NULL)",
    "registered_sections": "SELECT section_id, n_acts FROM (SELECT DISTINCT section_id, act_number::VARCHAR AS n, act_year AS y FROM legal_sections) JOIN (SELECT act_number AS n, act_year AS y, count(DISTINCT act_key) AS n_acts FROM acts WHERE act_number IS NOT NULL AND act_year IS NOT NULL GROUP BY 1, 2) USING (n, y)",
    "annotation_template": "SELECT DISTINCT item_id, question, query_type, NULL::VARCHAR AS answer, NULL::VARCHAR AS annotator_id, NULL::VARCHAR AS notes FROM qac_items",
    "proofread_corpus": "SELECT DISTINCT section_id, md5(coalesce(c, text)) AS text_hash FROM legal_sections LEFT JOIN (SELECT record_id, min(clean_text) AS c FROM proofread_samples WHERE record_type = 'section' GROUP BY 1) ON section_id = record_id",
    "repointed_items": """WITH ids AS (SELECT DISTINCT passage_id AS p FROM passages WHERE passage_id IS NOT NULL), m AS (SELECT p AS old, string_split(p, '_CHUNK_')[1] AS new FROM ids WHERE string_split(p, '_CHUNK_')[1] <> p AND string_split(p, '_CHUNK_')[1] IN (SELECT p FROM ids)),
      e AS (SELECT item_id, l, unnest(range(len(l))) AS no, unnest(l) AS p FROM (SELECT DISTINCT item_id, relevant_passages AS l FROM qac_items))
      SELECT item_id, string_agg(coalesce(new, p), '|' ORDER BY no) AS passages FROM e LEFT JOIN m ON e.p = m.old GROUP BY item_id, l""",
    "structured_answers": f"""WITH a AS (SELECT DISTINCT entry_id || '|' || md5(answer) AS key, answer FROM audit_log WHERE answer IS NOT NULL), c AS ({_CITED}), k AS (SELECT DISTINCT act_name, metadata.section_number AS section, 1 AS known FROM passages WHERE metadata.section_number IS NOT NULL),
      s AS (SELECT key, arg_min(act_name || ', Section ' || section, no) AS law, count(known) AS n_excerpts FROM c LEFT JOIN k USING (act_name, section) GROUP BY 1)
      SELECT key, md5(CASE WHEN len(string_split(answer, '.')) >= 2 THEN array_to_string(string_split(answer, '.')[1:2], '. ') || '.' ELSE left(answer, 200) || '...' END) AS summary_hash, coalesce(law, 'General legal principles') AS law, coalesce(n_excerpts, 0) AS n_excerpts FROM a LEFT JOIN s USING (key)""",
    "unused_passages": "SELECT corpus_pos, passage_id FROM passages WHERE passage_id IS NOT NULL AND passage_id NOT IN (SELECT p FROM (SELECT unnest(relevant_passages) AS p FROM qac_items) WHERE p IS NOT NULL)",
    "mention_list": f"""WITH s AS (SELECT section_id, min(text) AS text FROM legal_sections GROUP BY 1), t AS (SELECT section_id, text FROM s WHERE text <> ''),
      am AS (SELECT DISTINCT section_id, 'amendment' AS kind, regexp_extract(m, '{_ACTNO}$', 1, 'i') || ' of ' || regexp_extract(m, '{_ACTNO}$', 2, 'i') AS target FROM ({' UNION ALL '.join(f"SELECT section_id, unnest(regexp_extract_all(text, '{w}{_ACTNO}', 0, 'i')) AS m FROM t" for w in N.AMENDING)})),
      rf AS (SELECT section_id, lower(right(unnest(g), 20)) AS c, unnest(x) AS target FROM (SELECT section_id, regexp_extract_all(text, '{_SECT}', 1, 'i') AS x, string_split_regex(text, '(?i){_SECT}')[1:len(regexp_extract_all(text, '{_SECT}', 1, 'i'))] AS g FROM t)),
      ex AS (SELECT section_id, 'external_act' AS kind, trim(unnest(regexp_extract_all(text, '([A-Z][^(]+?)\\s*\\(Act No\\.\\s*(\\d+)\\s+of\\s+(\\d{{4}})\\)', 1))) AS target FROM t)
      SELECT section_id, kind, target, count(*) AS n FROM (SELECT * FROM am UNION ALL SELECT section_id, CASE WHEN contains(c, 'defined in') THEN 'definition' WHEN contains(c, 'subject to') THEN 'condition' WHEN contains(c, 'see') THEN 'see_also' ELSE 'general' END, target FROM rf UNION ALL SELECT * FROM ex) GROUP BY 1, 2, 3""",
    "prompt_hash": _HB + f""", {_P3E}, p3 AS (SELECT *, CASE WHEN {_VALID.format(c='metadata.article_number')} THEN metadata.article_number END AS a, CASE WHEN {_VALID.format(c='metadata.section_number')} THEN metadata.section_number END AS s,
        nullif(regexp_extract(passage_id, '^ACT__\\d+_SEC_([0-9]+[A-Z]?)', 1), '') AS fi, nullif(regexp_extract(coalesce(text, ''), '(?:^|[^0-9])(\\d{{1,3}}[A-Z]?)\\.\\s+[A-Z][a-z]', 1), '') AS ft FROM p2 WHERE place <= 10),
      p4 AS (SELECT query_id, place, coalesce(text, '') AS text, coalesce(a, CASE WHEN s IS NULL THEN coalesce(fi, ft) END, s, '[not identified]') AS sec, coalesce(a, CASE WHEN s IS NULL THEN coalesce(fi, ft) END) IS NOT NULL AS is_article, CASE WHEN coalesce(act_name, '') = '' OR contains(lower(act_name), 'constitution') THEN 'Constitution' ELSE act_name END AS act FROM p3),
      p5 AS (SELECT *, CASE WHEN is_article OR act = 'Constitution' THEN 'Article' ELSE 'Section' END AS label FROM p4)
      SELECT query_id, md5(string_agg(CASE WHEN place = 1 THEN 'PRIMARY EVIDENCE:' || chr(10) || 'Act: ' || act || chr(10) || label || ': ' || sec || chr(10) || 'Text: ' || text || chr(10)
        ELSE CASE WHEN place = 2 THEN 'SUPPORTING EVIDENCE:' || chr(10) ELSE '' END || chr(10) || (place - 1) || '. Act: ' || act || chr(10) || '   ' || label || ': ' || sec || chr(10) || '   Text: ' || text || chr(10) END, chr(10) ORDER BY place)) AS prompt_hash FROM p5 GROUP BY 1""",
    "dispatched_methods": "SELECT DISTINCT retrieval_method, retrieval_method AS with_vectors, 'bm25' AS without_vectors FROM audit_log WHERE retrieval_method IN ('bm25', 'dense', 'hybrid', 'hybrid_rerank')",
}
_MENTIONS = SQL["mention_list"].replace("s AS (SELECT section_id, min(text) AS text FROM legal_sections GROUP BY 1)", "s AS (SELECT DISTINCT section_id, text FROM legal_sections)")
_PROMPT = SQL["prompt_hash"]
_AT = _PROMPT.index("md5(string_agg(")
#: SQL of queries of other modules that is made from the statements above.
SQL |= {
    "mentions": _MENTIONS[: _MENTIONS.rindex("SELECT section_id, kind, target, count(*) AS n")] + "SELECT section_id, kind, count(*) AS n" + _MENTIONS[_MENTIONS.rindex("SELECT section_id, kind, target, count(*) AS n") + len("SELECT section_id, kind, target, count(*) AS n") :].replace("GROUP BY 1, 2, 3", "GROUP BY 1, 2"),
    "evidence_prompt": _PROMPT[:_AT] + "length(p)::INT AS n_chars, len(string_split(p, 'Act: '))::INT AS n_parts FROM (SELECT query_id, " + _PROMPT[_AT + 4 :].replace(") AS prompt_hash", " AS p") + ")",
}
