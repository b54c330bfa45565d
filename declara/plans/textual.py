"""Text functions and text features."""

from __future__ import annotations

from pyspark.sql import functions as F

from declara import constants as K
from declara.functions import text as T
from declara.operators import encode as E
from declara.operators import features as X
from declara.operators import topics as TP
from declara.plans import views as W
from declara.plans.registry import Tables, query
from declara.plans.views import r6
from declara.runtime import stage

# -- cleaning chains in SQL -----------------------------------------------------------


def _re(pattern: str) -> str:
    return W.sql_text(pattern)


def sql_repair(x: str) -> str:
    x = f"replace({x}, chr(156), 'oe')"
    x = f"replace({x}, chr(146), '''')"
    return f"translate({x}, chr(13) || chr(10) || chr(9), '   ')"


def sql_clean(x: str) -> str:
    x = sql_repair(x)
    for article in K.ELIDED_ARTICLES:
        x = f"replace({x}, {W.sql_text(article)}, '')"
    x = f"regexp_replace({x}, {_re('(' + T.PAD_TWICE + ')')}, '  \\1  ', 'g')"
    x = f"regexp_replace({x}, {_re('(' + T.char_class(K.PADDED_CHARACTERS + '^') + ')')}, ' \\1 ', 'g')"
    return f"replace({x}, chr(133), '')"


def sql_misspell(x: str) -> str:
    for wrong in sorted(K.MISSPELLINGS, key=len, reverse=True):
        x = f"replace({x}, {W.sql_text(wrong)}, {W.sql_text(K.MISSPELLINGS[wrong])})"
    return x


def sql_preprocess(x: str) -> str:
    x = sql_misspell(f"regexp_replace({sql_clean(f'lower({x})')}, '[0-9]+', '', 'g')")
    x = f"regexp_replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), ' +', ' ', 'g')"
    return f"coalesce(replace({x}, '/', ''), '')"


# Each text carries a misspelling inside, so that the corrections have work on these tables.
MISSPELT_SQL = "text || ' lautomate et l''hypoglycemie cest adenopathies ' || source"


def _misspelt():
    return F.concat("text", F.lit(" lautomate et l'hypoglycemie cest adenopathies "), "source")


@query("fn_deaccent", f"SELECT doc_id, {W.sql_deaccent('text')} AS text, {W.sql_fold('text')} AS folded FROM documents")
def _(t: Tables):
    return t.texts.select("doc_id", T.deaccent(F.col("text")).alias("text"), T.fold(F.col("text")).alias("folded"))


@query("fn_fix_misspell", f"SELECT doc_id, {sql_misspell(MISSPELT_SQL)} AS text FROM documents")
def _(t: Tables):
    return t.texts.select("doc_id", T.fix_misspellings(_misspelt()).alias("text"))


@query("fn_clean_text", f"SELECT doc_id, {sql_clean('text')} AS text FROM documents")
def _(t: Tables):
    return t.texts.select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query("fn_clean_text_strip", f"""
SELECT doc_id, replace(regexp_replace({sql_repair('text')}, {_re(T.ANY_MARK)}, '', 'g'), chr(133), '') AS text FROM documents""")
def _(t: Tables):
    return t.texts.select("doc_id", T.strip_marks(F.col("text")).alias("text"))


@query("fn_clean_numbers", "SELECT doc_id, regexp_replace(text, '[0-9]+', '', 'g') AS text FROM documents")
def _(t: Tables):
    return t.texts.select("doc_id", T.drop_numbers(F.col("text")).alias("text"))


@query("fn_preprocess_text", f"SELECT doc_id, {sql_preprocess(MISSPELT_SQL)} AS text FROM documents")
def _(t: Tables):
    return t.texts.select("doc_id", T.preprocess_text(_misspelt()).alias("text"))


@query("fn_normalise_spacing", r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(translate(text, chr(13) || chr(10), '  '),
  '([0-9]+)([^0-9])', '\1 \2', 'g'), '([\\/])([\p{L}\p{N}_])', '\1 \2', 'g'), ' +', ' ', 'g') AS text FROM documents""")
def _(t: Tables):
    return t.texts.select("doc_id", T.normalise_spacing(F.col("text")).alias("text"))


@query("fn_tokens", f"SELECT doc_id, array_to_string({W.sql_tokens('text')}, ' ') AS tokens FROM documents")
def _(t: Tables):
    return t.texts.select("doc_id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


PLAIN_SQL = r"regexp_extract_all(lower(text), '([\p{L}\p{N}]+|[^\p{L}\p{N}\s])')"


@query("fn_tokens_keep_stop", f"""
SELECT doc_id, array_to_string({PLAIN_SQL}, ' ') AS all_tokens,
  array_to_string(list_filter({PLAIN_SQL}, lambda w: w NOT IN ({W.sql_list(K.STOP_WORDS + list(K.ASCII_PUNCTUATION))})), ' ') AS tokens
FROM documents""")
def _(t: Tables):
    return t.texts.select(
        "doc_id", F.array_join(T.plain_tokens(F.col("text")), " ").alias("all_tokens"),
        F.array_join(T.plain_tokens(F.col("text"), K.STOP_WORDS), " ").alias("tokens"),
    )


LEXICON_SQL = """
lexicon AS (SELECT DISTINCT s.term AS term, substr(s.term, 1, length(s.term) - 1) AS lemma FROM stats s
  WHERE s.term LIKE '%s' AND EXISTS (SELECT 1 FROM stats r WHERE r.term || 's' = s.term))"""


@query("fn_lemma_lookup", f"""
WITH {W.BOW}, {LEXICON_SQL}
SELECT doc_id, coalesce(lemma, w.term) AS term, count(*) AS tf FROM words w LEFT JOIN lexicon USING (term) GROUP BY ALL""")
def _(t: Tables):
    docs = stage(t.texts.select("doc_id", T.tokens(F.col("text")).alias("words")))  # read for the counts and for the words
    rows = X.token_rows(docs, "doc_id", F.col("words"), positions=True)
    stats = stage(rows.groupBy("term").agg(F.count("*").alias("cf")))
    # A stand-in lexicon: a plural whose singular occurs in the corpus has the singular as lemma.
    singular = stats.select(F.concat("term", F.lit("s")).alias("term"), F.col("term").alias("lemma"))
    lexicon = singular.join(stats.select("term"), "term", "left_semi")
    return X.lemmatise(rows, "doc_id", lexicon, stats).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query("fn_clean_manufacturer", f"""
SELECT s_suppkey, array_to_string(list_filter(flatten(list_transform(list_filter(
  string_split({W.sql_fold("s_name || ' SAS France ' || n_name")}, ' '), lambda w: w NOT IN ({W.sql_list(K.COMPANY_WORDS)})),
  lambda w: string_split_regex(w, '[^a-z]+'))), lambda w: length(w) > 2), ' ') AS name
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def _(t: Tables):
    named = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return named.select("s_suppkey", T.clean_manufacturer(F.concat("s_name", F.lit(" SAS France "), "n_name")).alias("name"))


@query("fn_reference_vocab", f"""
SELECT DISTINCT term FROM (SELECT unnest(string_split_regex(lower(string_split(p_name || ' ' || p_type || ': ' || p_brand, ':')[1]), '[^a-z]+')) AS term FROM part)
WHERE length(term) > 2 AND term NOT IN ({W.sql_list(K.STOP_WORDS)})""")
def _(t: Tables):
    label = F.concat_ws(" ", "p_name", F.concat("p_type", F.lit(":")), "p_brand")
    head = F.lower(F.split(label, ":")[0])
    words = t.part.select(F.explode(F.split(head, "[^a-z]+")).alias("term"))
    return words.where((F.length("term") > 2) & ~F.col("term").isin(K.STOP_WORDS)).distinct()


# 'deces' does not occur in the invented prose; appending a word of it to some rows gives the rule work.
DEATH_SQL = "text || CASE WHEN n_chars % 7 = 0 THEN ' Le patient est décédé' ELSE '' END"


def _death_text():
    return F.concat("text", F.when(F.col("n_chars") % 7 == 0, " Le patient est décédé").otherwise(""))


@query("fn_find_death", f"""
SELECT doc_id, CASE WHEN regexp_matches({W.sql_fold(DEATH_SQL)}, '{'|'.join(K.DEATH_STEMS)}') THEN 1 ELSE 0 END AS death FROM documents""")
def _(t: Tables):
    return t.texts.select("doc_id", T.mentions_death(_death_text()).alias("death"))


@query("fn_find_death_tokens", f"""
WITH d AS (SELECT doc_id, lang, CASE WHEN list_has_any(string_split({W.sql_fold(DEATH_SQL)}, ' '), [{W.sql_list(K.DEATH_WORDS)}]) THEN 1 ELSE 0 END AS death
  FROM documents)
SELECT lang, count(*) AS n, CAST(sum(death) AS BIGINT) AS deaths, round(avg(death), 6) AS rate,
  round(avg(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 6) AS critical_rate FROM d LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def _(t: Tables):
    d = t.documents.select("doc_id", "lang", T.mentions_death_word(F.split(T.fold(_death_text()), " ")).alias("death"))
    return d.join(t.labels, "doc_id", "left").groupBy("lang").agg(
        F.count("*").alias("n"), F.sum("death").alias("deaths"), r6(F.avg("death")).alias("rate"),
        r6(F.avg(F.when(F.col("toxic") == 1, 1).otherwise(0))).alias("critical_rate"),
    )


@query("fn_severity_code", f"""
WITH s AS (SELECT doc_id, list_extract([{W.sql_list(W.SEVERITIES)}], CAST(n_chars % 6 AS INTEGER) + 1) AS severity FROM documents),
c AS (SELECT *, list_position([{W.sql_list(W.SEVERITIES)}], severity) - 1 AS code FROM s)
SELECT doc_id, severity, CAST(code AS INTEGER) AS code, CASE WHEN severity = 'CRITI' THEN 0 WHEN severity IS NOT NULL THEN 1 END AS binary_code,
  severity AS name, CASE WHEN severity = 'CRITI' THEN 'CRITI' WHEN severity IS NOT NULL THEN 'NON CRITIQUE' END AS binary_name FROM c""")
def _(t: Tables):
    from declara.operators.projections import severity_code, severity_name

    levels = F.array(*[F.lit(s) for s in W.SEVERITIES])
    s = t.documents.select("doc_id", F.try_element_at(levels, (F.col("n_chars") % 6 + 1).cast("int")).alias("severity"))
    return s.select(
        "doc_id", "severity", severity_code(F.col("severity")).alias("code"), severity_code(F.col("severity"), True).alias("binary_code"),
        severity_name(severity_code(F.col("severity"))).alias("name"),
        severity_name(severity_code(F.col("severity"), True), True).alias("binary_name"),
    )


@query("fn_multi_one_hot", """
SELECT vec_id, array_to_string(list_transform(range(0, 10), lambda i: CASE WHEN i = label THEN 1 ELSE 0 END), '') AS indicator FROM embeddings""")
def _(t: Tables):
    from declara.operators.projections import one_hot_array

    return t.embeddings.select("vec_id", F.array_join(one_hot_array(F.col("label"), 10), "").alias("indicator"))


@query("fn_json_parse_terms", """
SELECT s_suppkey, lower(s_name) || ',nation' || s_nationkey AS terms FROM supplier""")
def _(t: Tables):
    text = F.concat(F.lit("[('"), F.lower("s_name"), F.lit("', 3), ('nation"), "s_nationkey", F.lit("', 1)]"))
    return t.supplier.select("s_suppkey", F.array_join(T.parse_terms(text), ",").alias("terms"))


@query("fn_pos_to_lemma", "SELECT p_partkey, p_name AS lemmas FROM part")  # the tags leave, whatever they are
def _(t: Tables):
    tagged = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(w, F.lit("_"), F.upper(F.reverse(w)), F.lit("_x"))), " ")
    return t.part.select("p_partkey", F.array_join(T.pos_to_lemma(tagged), " ").alias("lemmas"))


@query("fn_distinct_terms", f"""
SELECT doc_id, term FROM (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest({W.sql_tokens('text')}) AS term FROM documents))""")
def _(t: Tables):
    return t.texts.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))


@query("fn_concat_token_cols", f"""
SELECT doc_id, array_to_string(list_concat({W.sql_tokens('text')}, {W.sql_tokens("replace(source, '_', ' ')")}), ' ') AS tokens FROM documents""")
def _(t: Tables):
    both = F.concat(T.tokens(F.col("text")), T.tokens(F.replace("source", F.lit("_"), F.lit(" "))))
    return t.texts.select("doc_id", F.array_join(both, " ").alias("tokens"))


PIECES_SQL = "string_split(text, ' ')"


@query("fn_head_tail_trim", f"""
SELECT doc_id, array_to_string(CASE WHEN len({PIECES_SQL}) <= 25 THEN {PIECES_SQL}
  ELSE list_concat({PIECES_SQL}[1:13], {PIECES_SQL}[-12:]) END, ' ') AS words FROM documents""")
def _(t: Tables):
    return t.texts.select("doc_id", F.array_join(T.head_tail(F.split("text", " "), 25), " ").alias("words"))


@query("fn_trim_fields", f"""
WITH w AS (SELECT doc_id, {PIECES_SQL}[1:45] AS a, {PIECES_SQL}[46:205] AS b, {PIECES_SQL}[206:] AS c FROM documents),
k AS (SELECT *, len(a) + len(b) + len(c) + 4 <= 290 AS fits, least(len(a), 30) AS s, 128 + CAST(ceil((30 - least(len(a), 30)) / 2) AS BIGINT) AS mb,
  128 + CAST(floor((30 - least(len(a), 30)) / 2) AS BIGINT) AS mc FROM w),
z AS (SELECT doc_id, a, b, c, CASE WHEN fits THEN len(a) ELSE s END AS s,
  CASE WHEN fits THEN len(b) WHEN mc > len(c) THEN mb + mc - len(c) WHEN mb > len(b) THEN len(b) ELSE mb END AS n,
  CASE WHEN fits THEN len(c) WHEN mc > len(c) THEN len(c) WHEN mb > len(b) THEN mc + mb - len(b) ELSE mc END AS m FROM k),
t AS (SELECT doc_id, a[1:s] AS a, CASE WHEN len(b) <= n THEN b ELSE list_concat(b[1:CAST(round_even(n / 2, 0) AS BIGINT)], b[len(b) - (n - CAST(round_even(n / 2, 0) AS BIGINT)) + 1:]) END AS b,
  CASE WHEN len(c) <= m THEN c ELSE list_concat(c[1:CAST(round_even(m / 2, 0) AS BIGINT)], c[len(c) - (m - CAST(round_even(m / 2, 0) AS BIGINT)) + 1:]) END AS c FROM z)
SELECT doc_id, array_to_string(a, ' ') AS short, array_to_string(b, ' ') AS one, array_to_string(c, ' ') AS two,
  len(a) + len(b) + 3 AS zeros, len(c) + 1 AS ones, 290 - len(a) - len(b) - len(c) - 4 AS padding FROM t""")
def _(t: Tables):
    """Three fields in one budget, and the segment array of the sequence they make."""
    w = t.texts.select("doc_id", F.split("text", " ").alias("w"))
    fields = w.select("doc_id", T.trim_fields(F.slice("w", 1, 45), F.slice("w", 46, 160), F.slice("w", 206, 1 << 30)).alias("f")).select("doc_id", "f.*")
    marked = fields.withColumn("seg", T.segments(F.col("short"), F.col("one"), F.col("two"), 290))
    ones = F.aggregate("seg", F.lit(0).cast("bigint"), lambda a, x: a + x)
    zeros = F.array_position("seg", 1) - 1
    return marked.select(
        "doc_id", *[F.array_join(c, " ").alias(c) for c in ("short", "one", "two")], zeros.alias("zeros"), ones.alias("ones"), (F.size("seg") - zeros - ones).alias("padding"))


@query("fn_pad_mask", f"""
WITH n AS (SELECT doc_id, list_transform({PIECES_SQL}, lambda w: length(w)) AS ids FROM documents)
SELECT doc_id, array_to_string(list_concat(ids[1:40], list_transform(range(greatest(0, 40 - len(ids))), lambda i: 0)), ' ') AS ids,
  CAST(least(len(ids), 40) AS BIGINT) AS used FROM n""")
def _(t: Tables):
    ids = F.transform(F.split("text", " "), F.length)
    return t.texts.select(
        "doc_id", F.array_join(T.pad_right(ids, 40), " ").alias("ids"),
        F.aggregate(T.attention_mask(ids, 40), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("used"),
    )


@query("fn_score_transform", """
WITH s AS (SELECT vec_id, i, embedding[i]::DOUBLE * 10 AS v, embedding[i + 1]::DOUBLE * 10 AS w FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding))) AS i FROM embeddings)),
p AS (SELECT *, 1 / (1 + exp(-v)) AS a, 1 / (1 + exp(-w)) AS b FROM s)
SELECT vec_id, i, round(a, 6) AS sigmoid, round(ln(a), 6) AS log_sigmoid, round(exp(-pow(greatest(1 - v, 0), 2)), 6) AS l2_hinge,
  round(a + b, 6) AS added, round(a * b, 6) AS multiplied, round(greatest(a, b), 6) AS larger, round(1 - (1 - a) * (1 - b), 6) AS noisy_or FROM p""")
def _(t: Tables):
    from declara.functions import scores as S

    pairs = F.inline(F.transform(F.sequence(F.lit(1), F.size("embedding") - 1), lambda i: F.struct(
        i.cast("long").alias("i"), (F.get("embedding", i - 1).cast("double") * 10).alias("v"), (F.get("embedding", i).cast("double") * 10).alias("w"))))
    s = t.embeddings.select("vec_id", pairs)
    a, b = S.sigmoid(F.col("v")), S.sigmoid(F.col("w"))
    return s.select(
        "vec_id", "i", r6(a).alias("sigmoid"), r6(S.log_sigmoid(F.col("v"))).alias("log_sigmoid"), r6(S.hinge(F.col("v"), 2)).alias("l2_hinge"),
        *[r6(S.combine(a, b, how)).alias(n) for how, n in (("add", "added"), ("mul", "multiplied"), ("max", "larger"), ("noisy_or", "noisy_or"))],
    )


# -- vocabulary, phrases, TF-IDF ---------------------------------------------------------


def _bow(t: Tables):
    return X.doc2bow(t.texts, "doc_id", T.tokens(F.col("text")))


def _n_docs(t: Tables):
    return t.documents.select(F.count("*")).scalar()


@query("agg_term_stats", f"WITH {W.BOW} SELECT term, df, cf FROM stats")
def _(t: Tables):
    return X.term_stats(_bow(t))


VOCABULARY_SQL = W.BOW + """,
vocabulary AS (SELECT term, df, row_number() OVER (ORDER BY df DESC, term) AS rank FROM stats
  WHERE df >= 3 AND df <= 0.8 * (SELECT count(*) FROM documents) QUALIFY rank <= 500)"""


@query("ft_vocabulary", f"WITH {VOCABULARY_SQL} SELECT term, df, rank FROM vocabulary")
def _(t: Tables):
    return X.vocabulary(X.term_stats(_bow(t)), _n_docs(t), keep_n=500).select("term", "df", "rank")


@query("ft_doc2bow", f"WITH {VOCABULARY_SQL} SELECT doc_id, term, tf FROM bow JOIN vocabulary USING (term)")
def _(t: Tables):
    bow = _bow(t)
    vocabulary = X.vocabulary(X.term_stats(bow), _n_docs(t), keep_n=500)
    return X.doc2bow(t.texts, "doc_id", T.tokens(F.col("text")), vocabulary)


TFIDF_SQL = W.BOW + """,
terms AS (SELECT term, df FROM stats WHERE df >= 2 ORDER BY cf DESC, term LIMIT 2000),
weighted AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS x FROM bow JOIN terms USING (term))"""


@query("ft_tfidf", f"""
WITH {TFIDF_SQL} SELECT doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS value FROM weighted""")
def _(t: Tables):
    bow = _bow(t)
    terms = X.top_terms(X.term_stats(bow), 2, 2000)
    return X.tfidf(bow, "doc_id", terms, _n_docs(t)).select("doc_id", "term", r6("value").alias("value"))


@query("ft_tfidf_l1", f"""
WITH {TFIDF_SQL} SELECT doc_id, term, round(x / sum(abs(x)) OVER (PARTITION BY doc_id), 6) AS value FROM weighted""")
def _(t: Tables):
    bow = _bow(t)
    terms = X.top_terms(X.term_stats(bow), 2, 2000)
    return X.tfidf(bow, "doc_id", terms, _n_docs(t), "l1").select("doc_id", "term", r6("value").alias("value"))


@query("ft_column_features", """
WITH g AS (SELECT s_suppkey, unnest(list_transform(range(1, length(s_name) + 1), lambda i: substr(lower(s_name), CAST(i AS INTEGER), 1))) AS term FROM supplier),
b AS (SELECT s_suppkey, term, count(*) AS tf FROM g GROUP BY ALL), n AS (SELECT count(*) AS n FROM supplier),
d AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM b GROUP BY term ORDER BY cf DESC, term LIMIT 50),
w AS (SELECT s_suppkey, 'name' AS "column", term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM b JOIN d USING (term), n),
h AS (SELECT s_suppkey, term, count(*) AS tf FROM (SELECT s_suppkey, unnest(string_split(lower(n_name), '_')) AS term FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY ALL),
e AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM h GROUP BY term HAVING df >= 2 ORDER BY cf DESC, term LIMIT 20),
v AS (SELECT s_suppkey, 'nation' AS "column", term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM h JOIN e USING (term), n)
SELECT s_suppkey, "column", term, round(x / sqrt(sum(x * x) OVER (PARTITION BY s_suppkey)), 6) AS value FROM w
UNION ALL SELECT s_suppkey, "column", term, round(x / sum(abs(x)) OVER (PARTITION BY s_suppkey), 6) FROM v""")
def _(t: Tables):
    df = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    out = X.column_features(df, "s_suppkey", {
        "name": {"words": X.character_grams(F.lower("s_name"), 1, 1), "max_features": 50},
        "nation": {"words": F.split(F.lower("n_name"), "_"), "min_df": 2, "max_features": 20, "norm": "l1"},
    })
    return out.select("s_suppkey", "column", "term", r6("value").alias("value"))


@query("ft_char_grams", """
WITH w AS (SELECT p_partkey, ' ' || unnest(string_split(p_name, ' ')) || ' ' AS w FROM part),
g AS (SELECT p_partkey, unnest(list_concat(list_transform(range(1, length(w)), lambda i: substr(w, CAST(i AS INTEGER), 2)),
  list_transform(range(1, length(w) - 1), lambda i: substr(w, CAST(i AS INTEGER), 3)))) AS term FROM w)
SELECT p_partkey, term, count(*) AS tf FROM g GROUP BY ALL""")
def _(t: Tables):
    return X.doc2bow(t.part, "p_partkey", X.character_grams(F.col("p_name"), 2, 3, in_words=True))


PAIRS_SQL = f"""
w AS (SELECT doc_id, {W.sql_tokens('text')} AS w FROM documents),
uni AS (SELECT t, count(*) AS n FROM (SELECT unnest(w) AS t FROM w) GROUP BY t),
pairs AS (SELECT a, b, count(*) AS n_ab FROM (SELECT unnest(w[1:len(w) - 1]) AS a, unnest(w[2:]) AS b FROM w WHERE len(w) > 1) GROUP BY ALL)"""


@query("agg_bigram_stats", f"WITH {PAIRS_SQL} SELECT a, b, n_ab FROM pairs")
def _(t: Tables):
    return X.pair_counts(t.texts, T.tokens(F.col("text")))


PHRASES_SQL = PAIRS_SQL + """,
phrases AS (SELECT a, b, n_ab, (n_ab - 1) * ((SELECT count(*) FROM uni) + (SELECT count(*) FROM pairs)) / (x.n * y.n) AS score
  FROM pairs JOIN uni x ON x.t = a JOIN uni y ON y.t = b WHERE score > 2)"""


@query("ft_phrases", f"WITH {PHRASES_SQL} SELECT a, b, n_ab, round(score, 6) AS score FROM phrases")
def _(t: Tables):
    return X.phrases(t.texts, T.tokens(F.col("text"))).select("a", "b", "n_ab", r6("score").alias("score"))


def _merge_sql(words: str, n: str, phrases: str) -> str:
    """Relations that merge the pairs of ``phrases`` in the word lists (doc_id, w) of ``words``; the last is words{n} (doc_id, w)."""
    return f"""
flagged{n} AS (SELECT doc_id, i, t.a AS word, (p.a IS NOT NULL) AS hit
  FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS a, unnest(list_append(w[2:], NULL)) AS b FROM {words} WHERE len(w) > 0) t
  LEFT JOIN {phrases} p ON p.a = t.a AND p.b = t.b),
placed{n} AS (SELECT *, row_number() OVER (PARTITION BY doc_id, hit, run ORDER BY i) AS k
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, hit ORDER BY i) AS run FROM flagged{n})),
named{n} AS (SELECT doc_id, i, word, opens, lag(opens, 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS continues,
  lead(word) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM (SELECT doc_id, i, word, hit AND k % 2 = 1 AS opens FROM placed{n})),
words{n} AS (SELECT doc_id, list(CASE WHEN opens THEN word || '_' || next ELSE word END ORDER BY i) FILTER (NOT continues) AS w FROM named{n} GROUP BY doc_id)"""


TRIGRAMS_SQL = f"""
WITH {PHRASES_SQL}, {_merge_sql('w', '1', 'phrases').strip()},
uni2 AS (SELECT t, count(*) AS n FROM (SELECT unnest(w) AS t FROM words1) GROUP BY t),
pairs2 AS (SELECT a, b, count(*) AS n_ab FROM (SELECT unnest(w[1:len(w) - 1]) AS a, unnest(w[2:]) AS b FROM words1 WHERE len(w) > 1) GROUP BY ALL),
phrases2 AS (SELECT a, b FROM pairs2 JOIN uni2 x ON x.t = a JOIN uni2 y ON y.t = b
  WHERE n_ab >= 5 AND (n_ab - 5) * ((SELECT count(*) FROM uni2) + (SELECT count(*) FROM pairs2)) / (x.n * y.n) > 2),
{_merge_sql('words1', '2', 'phrases2').strip()}"""


@query("fn_ngram_apply", f"""{TRIGRAMS_SQL}
SELECT doc_id, array_to_string(w, ' ') AS words FROM words2""")
def _(t: Tables):
    docs = t.texts.select("doc_id", T.tokens(F.col("text")).alias("words"))
    both = X.merged_twice(docs, "doc_id", F.col("words")).where(F.size("trigrams") > 0)
    return both.select("doc_id", F.array_join("trigrams", " ").alias("words"))


@query("ft_trigrams", f"""{TRIGRAMS_SQL}
SELECT doc_id, array_to_string(words1.w, ' ') AS bigrams, array_to_string(words2.w, ' ') AS trigrams FROM words1 JOIN words2 USING (doc_id)""")
def _(t: Tables):
    docs = t.texts.select("doc_id", T.tokens(F.col("text")).alias("words"))
    both = X.merged_twice(docs, "doc_id", F.col("words")).where(F.size("trigrams") > 0)
    return both.select("doc_id", F.array_join("bigrams", " ").alias("bigrams"), F.array_join("trigrams", " ").alias("trigrams"))


@query("ft_token_index_pad", f"""
WITH w AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS term FROM (SELECT doc_id, {W.sql_tokens('text')} AS w FROM documents)),
v AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) AS ix FROM w GROUP BY term QUALIFY ix <= 300),
k AS (SELECT doc_id, list(ix ORDER BY pos) AS ids FROM w JOIN v USING (term) GROUP BY doc_id)
SELECT doc_id, array_to_string(list_concat(list_transform(range(greatest(0, 60 - len(ids))), lambda i: 0), ids[greatest(1, len(ids) - 59):]), ' ') AS ids FROM k""")
def _(t: Tables):
    rows = X.token_rows(t.texts, "doc_id", T.tokens(F.col("text")), positions=True)
    stats = rows.groupBy("term").agg(F.count("*").alias("cf"), F.lit(1).alias("df"))
    return X.token_indices(rows, "doc_id", stats, 300, 60).select("doc_id", F.array_join("ids", " ").alias("ids"))


KEYPHRASES_SQL = f"""
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(array_to_string(list_transform(
  list_filter(string_split_regex(regexp_replace({W.sql_fold('text')}, '[^\\p{{L}} ]', ' | ', 'g'), ' +'), lambda w: w <> ''),
  lambda w: CASE WHEN w IN ({W.sql_list(K.STOP_WORDS)}) THEN '|' ELSE w END), ' '), '|'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM documents),
r AS (SELECT doc_id, unnest(range(len(ps))) AS place, unnest(ps) AS phrase FROM p),
w AS (SELECT doc_id, place, phrase, len(string_split(phrase, ' ')) AS n, unnest(string_split(phrase, ' ')) AS word FROM r),
s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, word) / count(*) OVER (PARTITION BY doc_id, word) AS s FROM w),
g AS (SELECT doc_id, place, phrase, sum(s) AS score FROM s GROUP BY ALL)
SELECT doc_id, phrase, round(max(score), 10) AS score FROM g GROUP BY ALL"""


@query("ft_keyphrases", KEYPHRASES_SQL)
def _(t: Tables):
    return X.keyphrases(t.texts, "doc_id", F.col("text"), K.STOP_WORDS).select("doc_id", "phrase", F.round("score", 10).alias("score"))


@query("ft_medical_terms", f"""
WITH w AS (SELECT doc_id, {W.sql_tokens('text')} AS w FROM documents),
terms AS (SELECT DISTINCT w[1] || ' ' || w[2] AS term FROM (SELECT {W.sql_tokens('text')} AS w FROM benchmark) WHERE len(w) >= 2
  UNION SELECT DISTINCT w[1] FROM (SELECT {W.sql_tokens('text')} AS w FROM benchmark) WHERE len(w) >= 1),
grams AS (SELECT doc_id, unnest(w) AS term FROM w
  UNION ALL SELECT doc_id, unnest(w[1:len(w) - 1]) || ' ' || unnest(w[2:]) FROM w WHERE len(w) > 1)
SELECT DISTINCT doc_id, term FROM grams WHERE term IN (SELECT term FROM terms)""")
def _(t: Tables):
    listed = t.benchmark.select(T.tokens(F.col("text")).alias("w"))
    two = listed.where(F.size("w") >= 2).select(F.concat_ws(" ", F.col("w")[0], F.col("w")[1]).alias("term"))
    one = listed.where(F.size("w") >= 1).select(F.col("w")[0].alias("term"))
    return X.listed_terms(t.texts, "doc_id", T.tokens(F.col("text")), one.union(two), 2)


# -- topics read as sources ------------------------------------------------------------------

TOP_SQL = W.BOW + """,
top AS (SELECT source, term, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, term) AS rank
  FROM words GROUP BY source, term QUALIFY rank <= {k})"""


def _top_words(t: Tables, k: int):
    from declara.operators.aggregations import word_counts

    return word_counts(W.words(t).select("source", "term"), "source", k=k)


@query("ml_topic_distance", f"""
WITH {TOP_SQL.format(k=50)}, s AS (SELECT source, list(term) AS ts FROM top GROUP BY source)
SELECT x.source AS a, y.source AS b, round(1 - len(list_intersect(x.ts, y.ts)) / len(list_distinct(list_concat(x.ts, y.ts))), 6) AS dist FROM s x, s y""")
def _(t: Tables):
    return TP.topic_distance(_top_words(t, 50), "source").select("a", "b", r6("dist").alias("dist"))


@query("ml_coherence_umass", f"""
WITH {TOP_SQL.format(k=20)},
seen AS (SELECT b.doc_id, t.source, t.rank FROM bow b JOIN top t USING (term)),
single AS (SELECT source, rank, count(*) AS d FROM seen GROUP BY ALL),
co AS (SELECT x.source, x.rank AS i, y.rank AS j, count(*) AS d FROM seen x JOIN seen y ON x.doc_id = y.doc_id AND x.source = y.source AND y.rank < x.rank GROUP BY ALL),
pairs AS (SELECT x.source, x.rank AS i, y.rank AS j FROM top x JOIN top y ON x.source = y.source AND y.rank < x.rank)
SELECT p.source AS topic, round(avg(ln((coalesce(co.d, 0) + 1) / s.d)), 6) AS coherence, count(*) AS pairs
FROM pairs p LEFT JOIN co USING (source, i, j) JOIN single s ON s.source = p.source AND s.rank = p.j GROUP BY p.source""")
def _(t: Tables):
    from declara.operators.aggregations import word_counts

    docs = stage(t.texts.select("doc_id", "source", T.tokens(F.col("text")).alias("words")))  # read for the best words and for where they occur
    top = word_counts(docs.select("source", F.explode("words").alias("term")), "source", k=20)
    bow = docs.select("doc_id", F.explode(F.array_distinct("words")).alias("term"))
    out = TP.coherence_umass(bow, "doc_id", top, "source")
    return out.select("topic", r6("coherence").alias("coherence"), "pairs")


# -- codes and splits ---------------------------------------------------------------------------


@query("ft_label_encode", """
WITH old AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT p_name AS value FROM part WHERE p_size <= 3)),
fresh AS (SELECT DISTINCT p_name AS value FROM part WHERE p_size BETWEEN 4 AND 6 AND p_name NOT IN (SELECT value FROM old)),
codes AS (SELECT value, code FROM old UNION ALL SELECT value, (SELECT max(code) FROM old) + row_number() OVER (ORDER BY value) FROM fresh)
SELECT p_partkey, CAST(coalesce(code, -1) AS BIGINT) AS code FROM part LEFT JOIN codes ON p_name = value""")
def _(t: Tables):
    old = E.label_codes(t.part.where(F.col("p_size") <= 3), "p_name")
    codes = E.extend_codes(old, t.part.where(F.col("p_size").between(4, 6)), "p_name")
    return E.encode(t.part, "p_name", codes, "code").select("p_partkey", "code")


@query("ft_one_hot", """
WITH b AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT p_brand AS value FROM part)),
y AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT p_type AS value FROM part WHERE p_type <> 'PROMO'))
SELECT p_partkey, 'p_brand' AS "column", code, 2.0::DOUBLE AS v FROM part JOIN b ON p_brand = value
UNION ALL SELECT p_partkey, 'p_type', code, 2.0::DOUBLE FROM part JOIN y ON p_type = value""")
def _(t: Tables):
    codes = {"p_brand": E.label_codes(t.part, "p_brand"), "p_type": E.label_codes(t.part.where(F.col("p_type") != "PROMO"), "p_type")}
    return E.one_hot_rows(t.part, "p_partkey", ["p_brand", "p_type"], codes, 2.0)


@query("ft_multilabel_binarize", """
WITH l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
c AS (SELECT l_suppkey AS value, row_number() OVER (ORDER BY l_suppkey) - 1 AS code FROM (SELECT DISTINCT l_suppkey FROM lineitem))
SELECT l_orderkey, code FROM l JOIN c ON l_suppkey = value""")
def _(t: Tables):
    sets = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("labels"))
    return E.indicator_rows(sets, "l_orderkey", "labels", E.label_codes(t.lineitem, "l_suppkey"))


@query("spl_group_shuffle", "SELECT count(*) AS texts, 0::BIGINT AS straddling, TRUE AS a_fifth FROM (SELECT DISTINCT text FROM documents)")
def _(t: Tables):
    split = E.split_by_text(t.documents.select("text"), "text")
    sides = split.groupBy("text").agg(F.count_distinct("is_test").alias("sides"), F.max("is_test").alias("test"))
    return sides.agg(
        F.count("*").alias("texts"), F.count_if(F.col("sides") > 1).alias("straddling"), F.avg(F.col("test").cast("int")).between(0.1, 0.3).alias("a_fifth"))


@query("spl_multilabel_stratified", """
SELECT source, lang, count(*) AS n, CAST(floor(count(*) * 0.2) AS BIGINT) AS n_test FROM documents GROUP BY ALL""")
def _(t: Tables):
    split = E.stratified_split(t.documents.select("doc_id", "source", "lang"), ["source", "lang"], "doc_id")
    return split.groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_if("is_test").alias("n_test"))


@query("spl_stratified_kfold", """
SELECT source, fold::INT AS fold, count(*) AS n FROM (SELECT source, (row_number() OVER (PARTITION BY source) - 1) % 5 AS fold FROM documents) GROUP BY ALL""")
def _(t: Tables):
    folds = E.stratified_folds(t.documents.select("doc_id", "source"), ["source"], "doc_id", 5)
    return folds.groupBy("source", "fold").agg(F.count("*").alias("n"))


@query("smp_balanced", """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), m AS (SELECT sum(n) / count(*) AS mean FROM c),
k AS (SELECT doc_id, source, floor(mean / n) AS w, CASE WHEN (('0x' || substr(md5('1029:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE < mean / n - floor(mean / n) THEN 1 ELSE 0 END AS extra
  FROM documents JOIN c USING (source), m)
SELECT doc_id, source, CAST(unnest(range(1, CAST(w + extra AS BIGINT) + 1)) AS INT) AS copy FROM k""")
def _(t: Tables):
    return E.balanced_sample(t.documents.select("doc_id", "source"), "source", "doc_id")
