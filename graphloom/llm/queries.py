"""One registered query per operator, over its whole table, and SQL where SQL can express it."""

import public_tokenizers
from pyspark.sql import functions as F

from graphloom.llm import ann, bpe, crf_quality, exact_dedup, ngram_join, packing, preference, spelling, spotsigs, substring, url_filter, vector_codes, warc
from graphloom.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op2_crf_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    field = crf_quality.train(docs, table(spark, sf_dir, "labels"))
    out = crf_quality.score(docs, field)
    return out.select("doc_id", crf_quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op3_spotsigs(spark, sf_dir):
    return spotsigs.compare_edits(table(spark, sf_dir, "documents"))


@query
def op3_near_pairs(spark, sf_dir):
    return spotsigs.near_pairs(table(spark, sf_dir, "documents"))


@query
def op4_url_filter(spark, sf_dir):
    labelled = spark.createDataFrame(url_filter.LABELLED, "url string, label int")
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.train(labelled))


@query
def op6_ngram_join(spark, sf_dir):
    return ngram_join.join_documents(table(spark, sf_dir, "documents"))


@query
def op7_substring_dedup(spark, sf_dir):
    return substring.digest_kept(table(spark, sf_dir, "documents"))


@query
def op8_warc_derivatives(spark, sf_dir):
    responses = warc.responses_of(table(spark, sf_dir, "pages"), "2024-01-01T00:00:00Z")
    return warc.derive(responses, carry=("page_id",))


@query
def op9_preference_format(spark, sf_dir):
    pairs = preference.stale_answers(table(spark, sf_dir, "conversations"))
    out = preference.format_pairs(pairs, "conv_id")
    return out.withColumns({c: preference.spans_text(F.col(c)) for c in ("chosen_spans", "rejected_spans")})


@query
def op5_pack_sequences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added)


@query
def op10_posting_lists(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"))


@query
def op11_spelling_groups(spark, sf_dir):
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


@query
def op12_exact_dedup(spark, sf_dir):
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


@query
def op13_vector_codes(spark, sf_dir):
    coded, books = vector_codes.codes(table(spark, sf_dir, "embeddings"))
    return vector_codes.label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


ORACLES["op9_preference_format"] = """
WITH t AS (
  SELECT conv_id, list_sort(list({'turn': coalesce(turn, -1), 'role': coalesce(role, ''), 'text': coalesce(text, '')})) AS ts
  FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations) GROUP BY conv_id, alone),
a AS (SELECT *, list_filter(generate_series(1, len(ts)), lambda i: ts[i].role = 'assistant') AS ans FROM t),
p AS (
  SELECT conv_id,
    CASE WHEN len(ans) > 0 THEN ts[1:ans[-1]] ELSE ts END AS c,
    CASE WHEN len(ans) > 0 THEN list_concat(ts[1:ans[-1] - 1], [{'turn': ts[ans[-1]].turn, 'role': 'assistant',
      'text': CASE WHEN len(ans) > 1 THEN ts[ans[-2]].text ELSE 'I have no answer to that.' END}]) ELSE ts END AS r
  FROM a),
n AS (
  SELECT *, coalesce(list_filter(generate_series(1, least(len(c), len(r))), lambda i: c[i].role <> r[i].role OR c[i].text <> r[i].text)[1] - 1,
    least(len(c), len(r))) AS k FROM p),
s AS (
  SELECT conv_id, k, list_transform(c, lambda x: '<|start|>' || x.role || chr(10) || x.text || '<|end|>' || chr(10)) AS cr,
    list_transform(r, lambda x: '<|start|>' || x.role || chr(10) || x.text || '<|end|>' || chr(10)) AS rr, c, r FROM n)
SELECT conv_id, k::INT AS n_prompt_turns, coalesce(array_to_string(cr[1:k], ''), '') AS prompt,
  coalesce(array_to_string(cr[k + 1:], ''), '') AS chosen, coalesce(array_to_string(rr[k + 1:], ''), '') AS rejected,
  coalesce(array_to_string(list_transform(list_filter(generate_series(k + 1, len(c)), lambda i: c[i].role = 'assistant'),
    lambda i: (coalesce(list_sum(list_transform(cr[k + 1:i - 1], lambda x: length(x))), 0) + 19)::BIGINT::VARCHAR || '+' || (length(c[i].text) + 8)::VARCHAR), ','), '') AS chosen_spans,
  coalesce(array_to_string(list_transform(list_filter(generate_series(k + 1, len(r)), lambda i: r[i].role = 'assistant'),
    lambda i: (coalesce(list_sum(list_transform(rr[k + 1:i - 1], lambda x: length(x))), 0) + 19)::BIGINT::VARCHAR || '+' || (length(r[i].text) + 8)::VARCHAR), ','), '') AS rejected_spans
FROM s
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# checksums from a table of 256 remainders made by rule; near words meet by what is left without one letter
ORACLES["op11_spelling_groups"] = f"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce(list_prepend(i, generate_series(1, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(generate_series(0, 255))::BIGINT AS i)),
runs AS (
  SELECT doc_id, w, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]{{6,}}')) AS w FROM documents) GROUP BY ALL),
bytes AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM runs),
sums AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(generate_series(1, length(x) // 2), lambda i: ('0x' || x[2 * i - 1:2 * i])::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM bytes, tab),
spelled AS (
  SELECT CASE WHEN h % 199 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM sums),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(generate_series(1, length(word))) AS i FROM words)),
near AS (
  SELECT DISTINCT a.word AS word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, v.word FROM cut c JOIN words v ON c.rest = v.word
  UNION SELECT v.word, c.word FROM cut c JOIN words v ON c.rest = v.word),
best AS (
  SELECT p.word, count(*) AS n_near, first(o.word ORDER BY o.n DESC, o.word) AS other, max(o.n) AS other_n
  FROM near p JOIN words o ON p.other = o.word GROUP BY p.word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
walk AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT k.word, f.form FROM walk k JOIN forms f ON k.at = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT k.word, k.at AS root FROM walk k JOIN forms f ON k.at = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r ON f.word = r.word
"""

ORACLES["op12_exact_dedup"] = f"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def _lloyd_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """One pair of table expressions a round: nearest entries, then their floored means by component."""
    near = """a{k} AS MATERIALIZED (
  SELECT vec_id, p, v, arg_min({{'i': e, 'd': d}}, d * 16 + e) AS m FROM (
    SELECT x.vec_id, x.p, x.v, c.e, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts x JOIN c{k} c ON x.p = c.p) GROUP BY ALL)"""
    mean = """c{n} AS MATERIALIZED (
  WITH s AS (
    SELECT p, e, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT p, m.i AS e, unnest(v) AS x, unnest(generate_series(1, 8)) AS i FROM a{k}) GROUP BY ALL),
  f AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s GROUP BY p, e)
  SELECT c.p, c.e, coalesce(f.v, c.v) AS v FROM c{k} c LEFT JOIN f ON c.p = f.p AND c.e = f.e)"""
    steps = []
    for k in range(rounds):
        steps += [near.format(k=k), mean.format(k=k, n=k + 1)]
    steps.append(near.format(k=rounds))
    body = ",\n".join(steps)
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, v[p * 8 + 1:p * 8 + 8] AS v FROM kept, (SELECT unnest(generate_series(0, 7)) AS p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM parts QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 16),
{body},
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds}),
coded AS (SELECT vec_id, string_agg(printf('%02x', m.i), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), books
"""


ORACLES["op13_vector_codes"] = _lloyd_sql()
