"""Queries over the scalar text functions and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import spans as S
from corpusloom.sources.tables import table


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"), F.length(T.normalize_whitespace(F.col("text"))).alias("flat_length"))


def token_stats(spark: SparkSession, d: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_terms"))


def section_numbers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "legal_sections").select("section_id", "text", "section_number").distinct()
    return c.select("section_id", T.section_number(F.col("text")).alias("first_reference"), T.valid_section(F.col("section_number")).alias("valid_section"), F.md5("text").alias("text_hash"))


def passage_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "passages").select("corpus_pos", T.article_id(F.col("passage_id")).alias("article_id"), T.base_id(F.col("passage_id")).alias("base_id"))


def enactment_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "passages").select("corpus_pos", T.parse_date(F.col("metadata.enactment_date")).alias("enacted"))


def scan_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality of each section's text and whether it passes the limit of its year."""
    q = T.scan_quality(F.col("text"))
    limit = F.when(F.col("act_year") >= 2000, 0.95).otherwise(0.90)
    return table(spark, d, "legal_sections").select("section_id", F.round(q, 6).alias("quality"), (q >= limit).alias("passes"), F.md5("text").alias("text_hash")).distinct()


def edit_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of the sampled sections to their proofread text, both cleaned as the corpus is."""
    s = table(spark, d, "legal_sections").select(F.col("section_id").alias("record_id"), "text").distinct()
    p = table(spark, d, "proofread_samples").filter("record_type = 'section'").select("record_id", "clean_text").distinct()
    return p.join(s, "record_id").select("record_id", F.round(T.edit_accuracy(T.clean_text(F.col("text")), T.clean_text(F.col("clean_text"))), 6).alias("accuracy"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qac_items").select("item_id", "question").filter("item_id IS NOT NULL AND question IS NOT NULL").distinct()


def query_normalize(spark: SparkSession, d: str) -> DataFrame:
    q = _questions(spark, d).withColumn("normalized", T.expand_abbreviations(F.col("question")))
    n = F.col("normalized")
    return q.select("item_id", "normalized", T.query_type(n).alias("query_type"), F.array_join(T.section_references(n), "|").alias("section_refs"), F.array_join(T.article_references(n), "|").alias("article_refs"), F.array_join(T.years(n), "|").alias("years"), F.array_join(T.years(n, True), "|").alias("years_compat"), F.array_join(T.domain_terms(n), "|").alias("domains"), T.act_filter(F.col("question")).alias("act_filter"))


def query_classify(spark: SparkSession, d: str) -> DataFrame:
    q = _questions(spark, d)
    c, k, low = T.classify_query(F.col("question")), T.identify_domain(F.col("question")), F.lower("question")
    n = F.size(F.split(T.normalize_whitespace(F.col("question")), " "))
    return q.select(
        "item_id", c["name"].alias("query_type"), F.round(c["confidence"], 6).alias("type_confidence"), k["name"].alias("domain"), F.round(k["confidence"], 6).alias("domain_confidence"),
        T.strip(F.col("question")).endswith("?").alias("is_question"), T.has_any(low, ["not", "no", "never", "don't", "doesn't"]).alias("has_negation"), T.has_any(low, ["if", "when", "provided", "unless"]).alias("has_conditional"),
        F.when(n < 10, "simple").when(n < 25, "medium").otherwise("complex").alias("complexity"),
    )


def plain_wording(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "passages").select("corpus_pos", F.md5(T.plain_wording(F.col("text"))).alias("plain_hash"))


def answer_citations(spark: SparkSession, d: str) -> DataFrame:
    """One row per citation of the audited answers."""
    a = table(spark, d, "audit_log").select("entry_id", "answer").distinct()
    return a.select("entry_id", F.posexplode(S.citations(F.col("answer"))).alias("no", "c")).select("entry_id", "no", "c.act_name", "c.section", "c.full").distinct()


def citation_format(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "audit_log").filter("answer IS NOT NULL").select("entry_id", "answer").distinct()
    f = S.citation_format(F.col("answer"))
    return a.select("entry_id", f["total"].alias("n_brackets"), f["well_formed"].alias("n_well_formed"), F.round(S.citation_density(F.col("answer")), 6).alias("density"), (S.citation_density(F.col("answer")) >= 0.35).alias("adequate"))


def answer_claims(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "annotation_sheet").select("run_id", "item_id", "rag_answer").distinct()
    return a.select("run_id", "item_id", F.posexplode(S.claims(F.col("rag_answer"))).alias("no", "claim")).distinct()


def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every section's text as packed sentences of at most 1,500 characters, with both ways of counting the joining blanks."""
    t = table(spark, d, "legal_sections").filter("text <> ''").select("section_id", "text").distinct()
    both = t.select("section_id", F.lit("plain").alias("mode"), F.posexplode(S.greedy_chunks(F.col("text"), 1500)).alias("no", "chunk")).unionByName(t.select("section_id", F.lit("counted").alias("mode"), F.posexplode(S.greedy_chunks(F.col("text"), 1500, True)).alias("no", "chunk")))
    return both.unionByName(t.select("section_id", F.lit("overlap").alias("mode"), F.posexplode(S.overlapping_chunks(F.col("text"))).alias("no", "chunk")))


def article_chunks(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "constitution_articles").filter("full_text <> ''").select("article_id", "full_text").distinct()
    return t.select("article_id", F.posexplode(S.clause_chunks(F.col("full_text"))).alias("no", "chunk"))


QUERIES = {f.__name__: f for f in (clean_text, token_stats, section_numbers, passage_ids, enactment_dates, scan_quality, edit_accuracy, query_normalize, query_classify, plain_wording, answer_citations, citation_format, answer_claims, sentence_chunks, article_chunks)}

_WS = "[ \\t\\n\\x0B\\f\\r]"
_FLAT = f"regexp_replace(regexp_replace({{c}}, '{_WS}+', ' ', 'g'), '^{_WS}+|{_WS}+$', '', 'g')"
_CLEAN = f"regexp_replace({_FLAT}, '[^\\x00-\\x7F]+', '', 'g')"
_TOK = f"list_filter(list_transform(string_split_regex(lower(coalesce({{c}}, '')), '{_WS}+'), lambda w: trim(w, '.,;:!?''\"')), lambda w: w <> '')"
_Q = "(SELECT DISTINCT item_id, question FROM qac_items WHERE item_id IS NOT NULL AND question IS NOT NULL)"
_SECT = "(\\d+[A-Z]?(?:\\(\\d+\\)(?:\\([a-z]\\))?)?)"
_ABBR = "CASE lower(w) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.ABBREVIATIONS.items()) + " ELSE w END"
_NORM = f"array_to_string(list_transform(string_split({_FLAT.format(c='question')}, ' '), lambda w: {_ABBR}), ' ')"
_CITE = "\\[([^,\\]]+),\\s*(?:Article|Section|Chapter)?\\s*([0-9]+[A-Z]?(?:\\([0-9]+\\))?(?:\\([a-z]\\))?)\\]"


def _sql_best(scores: dict[str, str], least: str = "0") -> tuple[str, str]:
    top = f"greatest({', '.join(scores.values())})"
    total = " + ".join(scores.values())
    return f"CASE WHEN {top} <= {least} THEN 'general' " + " ".join(f"WHEN {s} = {top} THEN '{t}'" for t, s in scores.items()) + " END", f"CASE WHEN {top} <= {least} THEN 0.3 ELSE {top} / ({total}) END"


def _sql_text(x: str) -> str:
    return x.replace("'", "''")


_TYPE = {t: "(" + " + ".join([f"CASE WHEN regexp_matches(lower(question), '\\b{p}\\b') THEN 2.0 ELSE 0.0 END" for p in ps] + [f"CASE WHEN contains(lower(question), '{k}') THEN 0.5 ELSE 0.0 END" for k in ks]) + ")::DOUBLE" for t, (ps, ks) in T.QUERY_TYPE_SIGNS.items()}
_DOM = {t: "(" + " + ".join(f"len(regexp_extract_all(lower(question), '\\b{k}\\b'))" for k in ks) + ")::DOUBLE" for t, ks in T.DOMAIN_KEYWORDS.items()}
_STAT = {t: "CASE WHEN " + (" OR ".join(f"contains(lower(question), '{s}')" for s in T.DOMAIN_STATUTES.get(t, [])) or "false") + " THEN 5.0 ELSE 0.0 END::DOUBLE" for t in T.DOMAIN_KEYWORDS}
_QUALITY = "CASE WHEN length(coalesce(text, '')) < 100 THEN 0.0 ELSE greatest(0.0, 1.0 - (" + " + ".join(f"len(regexp_extract_all(text, '{_sql_text(s)}'))" for s in ("[^\\p{L}\\p{N}_\\s.,;:!?()\\[\\]{}'\"/\\-]{3,}", "\\b[a-z]{1,2}\\d{1,2}[a-z]{1,2}\\d{1,2}\\b", "\\b[IlO0]{4,}\\b")) + ") / (length(text) / 100.0) / 10.0) END"
_PLAIN = "text"
for _a, _b in T.PLAIN_WORDING:
    _PLAIN = f"regexp_replace({_PLAIN}, '\\b{_a}\\b', '{_b}', 'gi')"

SQL = {
    "clean_text": f"SELECT doc_id, regexp_replace({_FLAT.format(c='text')}, '[^\\x00-\\x7F]+', '', 'g') AS cleaned, length({_FLAT.format(c='text')})::INT AS flat_length FROM documents",
    "token_stats": f"SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_terms FROM (SELECT doc_id, {_TOK.format(c='text')} AS t FROM documents)",
    "section_numbers": f"""SELECT DISTINCT section_id, coalesce(nullif(regexp_extract(text, 'Section\\s+{_SECT}', 1, 'i'), ''), nullif(regexp_extract(text, 'Sec\\.\\s+{_SECT}', 1, 'i'), ''), nullif(regexp_extract(text, '^{_SECT}\\.', 1, 'i'), '')) AS first_reference,
      coalesce(regexp_full_match(trim(section_number), '[0-9]+[A-Z]?(\\([0-9]+\\))?(\\([a-z]\\))?'), false) AS valid_section, md5(text) AS text_hash FROM legal_sections""",
    "passage_ids": "SELECT corpus_pos, regexp_replace(passage_id, '_(CHUNK|SUBSEC)_.*$', '') AS article_id, string_split(passage_id, '_CHUNK_')[1] AS base_id FROM passages",
    "enactment_dates": "SELECT corpus_pos, coalesce(try_strptime(e, '%Y-%m-%d'), try_strptime(e, '%d/%m/%Y'), try_strptime(e, '%d-%m-%Y'))::DATE AS enacted FROM (SELECT corpus_pos, CASE WHEN regexp_full_match(metadata.enactment_date, '\\d{4}-\\d{1,2}-\\d{1,2}|\\d{1,2}[/-]\\d{1,2}[/-]\\d{4}') THEN metadata.enactment_date END AS e FROM passages)",
    "scan_quality": f"SELECT DISTINCT section_id, round({_QUALITY}, 6) AS quality, {_QUALITY} >= CASE WHEN act_year >= 2000 THEN 0.95 ELSE 0.90 END AS passes, md5(text) AS text_hash FROM legal_sections",
    "edit_accuracy": f"""SELECT record_id, round(CASE WHEN text = '' AND clean_text = '' THEN 1.0 WHEN text = '' OR clean_text = '' THEN 0.0
      ELSE 1.0 - levenshtein(x, y) / greatest(length(x), length(y)) END, 6) AS accuracy
      FROM (SELECT DISTINCT record_id, text, clean_text, left(text, 5000) AS x, left(clean_text, 5000) AS y FROM (SELECT record_id, {_CLEAN.format(c="coalesce(text, '')")} AS text, {_CLEAN.format(c='clean_text')} AS clean_text FROM (SELECT DISTINCT record_id, clean_text FROM proofread_samples WHERE record_type = 'section') JOIN (SELECT DISTINCT section_id AS record_id, text FROM legal_sections) USING (record_id)))""",
    "query_normalize": f"""SELECT item_id, n AS normalized,
      CASE WHEN regexp_matches(lower(n), '\\b(what|who|which|where)\\b') THEN 'factual' WHEN regexp_matches(lower(n), '\\b(how|when|process|procedure|step)\\b') THEN 'procedural'
        WHEN regexp_matches(lower(n), '\\b(mean|means|interpret|definition|define)\\b') THEN 'interpretive' WHEN len(regexp_extract_all(n, '[Ss]ection\\s+\\d+')) > 1 THEN 'cross_referenced' ELSE 'general' END AS query_type,
      array_to_string(regexp_extract_all(n, '[Ss]ection\\s+(\\d+[A-Z]?(?:\\([a-z0-9]+\\))?)', 1), '|') AS section_refs,
      array_to_string(regexp_extract_all(n, 'Article\\s+(\\d+[A-Z]?)', 1, 'i'), '|') AS article_refs,
      array_to_string(regexp_extract_all(n, '\\b((?:19|20)\\d{{2}})\\b', 1), '|') AS years, array_to_string(regexp_extract_all(n, '\\b(19|20)\\d{{2}}\\b', 1), '|') AS years_compat,
      array_to_string(list_filter([{', '.join(repr(t) for t in T.DOMAIN_TERMS)}], lambda t: contains(lower(n), t)), '|') AS domains,
      CASE WHEN regexp_matches(q, '\\bconstitution\\b') THEN '' WHEN regexp_matches(q, '\\bpenal\\s+code\\b') THEN 'Penal Code' WHEN regexp_matches(q, '\\bcivil\\s+procedure\\s+code\\b') THEN 'Civil Procedure Code'
        WHEN regexp_matches(q, '\\bevidence\\s+ordinance\\b') THEN 'Evidence Ordinance' WHEN regexp_matches(q, '\\bcriminal\\s+procedure\\s+code\\b') THEN 'Criminal Procedure Code'
        WHEN regexp_matches(q, 'article\\s+\\d+') AND NOT regexp_matches(q, '\\bsection\\b') THEN '' END AS act_filter
      FROM (SELECT item_id, {_NORM} AS n, lower(question) AS q FROM {_Q})""",
    "query_classify": f"""SELECT item_id, {_sql_best(_TYPE)[0]} AS query_type, round({_sql_best(_TYPE)[1]}, 6) AS type_confidence,
      CASE WHEN greatest({', '.join(_DOM.values())}) = 0 THEN {_sql_best(_STAT)[0]} ELSE {_sql_best(_DOM)[0]} END AS domain,
      round(CASE WHEN greatest({', '.join(_DOM.values())}) = 0 THEN {_sql_best(_STAT)[1]} ELSE {_sql_best(_DOM)[1]} END, 6) AS domain_confidence,
      suffix(regexp_replace(question, '{_WS}+$', ''), '?') AS is_question, regexp_matches(lower(question), 'not|no|never|don''t|doesn''t') AS has_negation, regexp_matches(lower(question), 'if|when|provided|unless') AS has_conditional,
      CASE WHEN n < 10 THEN 'simple' WHEN n < 25 THEN 'medium' ELSE 'complex' END AS complexity
      FROM (SELECT *, len(string_split({_FLAT.format(c='question')}, ' ')) AS n FROM {_Q})""",
    "plain_wording": f"SELECT corpus_pos, md5({_PLAIN}) AS plain_hash FROM passages",
    "answer_citations": f"""SELECT DISTINCT entry_id, no, trim(a) AS act_name, trim(s) AS section, f AS "full" FROM (
      SELECT entry_id, unnest(range(len(f)))::INT AS no, unnest(regexp_extract_all(answer, '{_CITE}', 1, 'i')) AS a, unnest(regexp_extract_all(answer, '{_CITE}', 2, 'i')) AS s, unnest(f) AS f
      FROM (SELECT DISTINCT entry_id, answer, regexp_extract_all(answer, '{_CITE}', 0, 'i') AS f FROM audit_log))""",
    "citation_format": f"""SELECT entry_id, len(b)::INT AS n_brackets, len(list_filter(b, lambda x: regexp_matches(x, '^{_CITE}', 'i')))::INT AS n_well_formed, round(dens, 6) AS density, dens >= 0.35 AS adequate FROM (
      SELECT entry_id, b, CASE WHEN n = 0 THEN 0.0 ELSE len(list_filter(p, lambda x: regexp_matches(x, '{_CITE}', 'i'))) / n END AS dens FROM (
        SELECT entry_id, b, p, len(list_filter(p, lambda x: length(regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')) > 10)) AS n FROM (
          SELECT entry_id, regexp_extract_all(answer, '\\[[^\\]]+\\]') AS b, string_split_regex(regexp_replace(regexp_replace(answer, '\\*?This information is for general reference[^*]*\\*?', '', 'gi'), '^{_WS}+|{_WS}+$', '', 'g'), '[.!?]+') AS p
          FROM (SELECT DISTINCT entry_id, answer FROM audit_log WHERE answer IS NOT NULL))))""",
    "answer_claims": f"""SELECT DISTINCT run_id, item_id, (unnest(range(len(c))))::INT AS no, unnest(c) AS claim FROM (SELECT run_id, item_id, list_filter(list_transform(string_split_regex(regexp_replace(rag_answer, '\\[.*?\\]', '', 'g'), '[.!?]+'), lambda s: regexp_replace(s, '^{_WS}+|{_WS}+$', '', 'g')),
      lambda s: length(s) > 10 AND NOT regexp_matches(lower(s), '{'|'.join(S.DISCLAIMERS)}')) AS c FROM (SELECT DISTINCT run_id, item_id, rag_answer FROM annotation_sheet))""",
    "sentence_chunks": f"""WITH RECURSIVE w AS (SELECT section_id, md5(text) AS h, string_split(regexp_replace(text, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1)) AS x FROM (SELECT DISTINCT section_id, text FROM legal_sections WHERE text <> '')),
      md AS (SELECT * FROM (VALUES ('plain', 1500, 0), ('counted', 1500, 1), ('overlap', 500, 0)) m(mode, lim, sep)),
      f AS (SELECT mode, lim, sep, section_id, h, x, 0::BIGINT AS i, 0::BIGINT AS no, []::VARCHAR[] AS cur, 0::BIGINT AS n, NULL::VARCHAR AS chunk FROM w CROSS JOIN md
        UNION ALL SELECT mode, lim, sep, section_id, h, x, i + 1, no + CASE WHEN chunk IS NULL THEN 0 ELSE 1 END,
          CASE WHEN i = len(x) THEN cur WHEN fl AND mode = 'overlap' THEN list_append(kept, x[i + 1]) WHEN fl THEN [x[i + 1]] ELSE list_append(cur, x[i + 1]) END,
          CASE WHEN i = len(x) THEN n WHEN fl AND mode = 'overlap' THEN coalesce(list_sum(list_transform(kept, lambda y: length(y))), 0)::BIGINT + length(x[i + 1]) WHEN fl THEN length(x[i + 1]) ELSE n + length(x[i + 1]) + sep END,
          CASE WHEN i = len(x) OR fl THEN array_to_string(cur, ' ') END
        FROM (SELECT *, len(cur) > 0 AND n + length(x[i + 1]) > lim AS fl, coalesce(list_filter(list_transform(range(1, len(cur) + 1), lambda j: cur[j:]), lambda l: list_sum(list_transform(l, lambda y: length(y))) <= 50)[1], []) AS kept FROM f WHERE i <= len(x)))
      SELECT section_id, mode, no::INT AS no, chunk FROM f WHERE chunk IS NOT NULL""",
}
