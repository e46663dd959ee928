"""The registered queries of the operators, over whole tables, and the SQL
that gives the same rows where SQL can express it."""

from __future__ import annotations

from provlens.llm import (bpe, chat, crosstok, htmltext, lattice, lexical, mixing, phrases, rules, runindex, shards,
                          simhash, warc)
from provlens.llm.common import table


def op1_source_mix(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op2_phrase_fingerprints(spark, sf_dir):
    return phrases.fingerprint_report(table(spark, sf_dir, "documents"))


def op3_main_text(spark, sf_dir):
    return htmltext.extracted(table(spark, sf_dir, "pages"))


def op4_lattice_score(spark, sf_dir):
    return lattice.scored(table(spark, sf_dir, "documents"))


def op5_long_repeats(spark, sf_dir):
    return runindex.repeat_report(table(spark, sf_dir, "documents"))


def op6_chat_format(spark, sf_dir):
    return chat.conversation_report(table(spark, sf_dir, "conversations"))


def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark, sf_dir):
    return rules.quality_report(table(spark, sf_dir, "documents"))


def op9_warc(spark, sf_dir):
    return warc.archived(table(spark, sf_dir, "pages"))


def op10_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op11_cross_alignment(spark, sf_dir):
    return crosstok.alignment(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark, sf_dir):
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_jump_shards(spark, sf_dir):
    return shards.shard_report(table(spark, sf_dir, "documents"))


WORDS_SQL = "len(regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+'))"


# Mixing. Water filling in closed form: in the order of max_rate * size / weight the first k sources are at
# their limit; the level follows from the rest.
OP1_SQL = f"""
WITH d AS (SELECT doc_id, source, {WORDS_SQL.format("coalesce(text, '')")} AS size,
             ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 13))::BIGINT AS h
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3)::INT + 1]::BIGINT AS w FROM s),
c AS (SELECT *, sum(3 * source_size) OVER o - 3 * source_size AS full_before, sum(w) OVER o - w AS w_before,
        sum(source_size) OVER () AS total, sum(w) OVER () AS w_all
      FROM r WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / w, encode(source) NULLS LAST ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, w * (total - full_before) > 3 * source_size * (w_all - w_before) AS capped FROM c),
l AS (SELECT sum(source_size) - coalesce(sum(3 * source_size) FILTER (capped), 0) AS words, sum(w) FILTER (NOT capped) AS share FROM k),
t AS (SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE
        ELSE (w * words)::DOUBLE / share::DOUBLE END AS target FROM k, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0 END AS rate FROM t),
q AS (SELECT *, floor(rate) AS whole, rate - floor(rate) AS part FROM p),
turns AS (SELECT q.source, turn, whole * source_size + sum(CASE WHEN ((h + turn * {mixing.STEP}) % {mixing.RANGE})::DOUBLE
            < part * {float(mixing.RANGE)!r}::DOUBLE THEN size ELSE 0 END) - target AS miss
          FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source, range({mixing.TURNS}) AS x(turn)
          GROUP BY q.source, turn, whole, source_size, target),
best AS (SELECT source, turn FROM turns QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(miss), turn) = 1)
SELECT d.doc_id, d.size, q.source_size, q.target, copies * d.size AS taken, copies
FROM (SELECT d.*, q.source_size, q.target, (whole + CASE WHEN ((h + turn * {mixing.STEP}) % {mixing.RANGE})::DOUBLE
        < part * {float(mixing.RANGE)!r}::DOUBLE THEN 1 ELSE 0 END)::BIGINT AS copies
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
      JOIN best b ON d.source IS NOT DISTINCT FROM b.source) AS d JOIN q ON d.source IS NOT DISTINCT FROM q.source
"""

OP9_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
r AS (SELECT *, CASE WHEN n >= {warc.REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM r
"""

# Quality rules. Measures first, then the rules of rules.default_rules(); windows are compared as word lists.
OP8_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT r, i, words[i:i + 7] AS g FROM w, unnest(range(1, len(words) - 6)) AS t(i)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range(8) AS t(k) GROUP BY r),
m AS (SELECT w.r, doc_id, text, words, lines, len(words)::BIGINT AS n_words,
        length(array_to_string(words, ''))::BIGINT AS word_chars,
        (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov ON w.r = cov.r),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR len(lines) > 2 * len(list_distinct(lines))
       OR word_chars < 2 * n_words OR word_chars > 14 * n_words
       OR 10 * length(regexp_replace(text, '[^\\p{Lu}]+', '', 'g')) > 4 * word_chars
       OR (n_words >= 100 AND 20 * list_sum(list_transform(range(0, (n_words + 99) // 100), lambda i:
             len(list_distinct(words[least(i * 100, n_words - 100) + 1:least(i * 100, n_words - 100) + 100]))))
           < 100 * ((n_words + 99) // 100))
       OR 5 * (length(text) - length(replace(text, '!', ''))) > n_words) AS kept
FROM f
"""

OP6_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(replace(text, '\', '\e'))
        + len(regexp_extract_all(text, '<(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>)'))
        + len(regexp_extract_all(text, '\[/?INST\]')) AS text_chars FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + text_chars + 12 + 1 + 11)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(text, '{lexical.UPPER}', '{lexical.LOWER}'), '{lexical.TERM}') AS terms FROM documents),
s AS (SELECT count(*)::BIGINT AS nd, sum(len(terms))::BIGINT AS nt FROM d WHERE len(terms) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, nd),
m AS (SELECT r, doc_id, 75 + (25 * len(terms) * nd) // nt AS m FROM d, s WHERE len(terms) > 0),
b AS (SELECT i, item_id, term, count(*) AS times FROM (
        SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(
          translate(text, '{lexical.UPPER}', '{lexical.LOWER}'), '{lexical.TERM}')) AS term FROM benchmark)
      GROUP BY i, item_id, term),
e AS (SELECT i, item_id, m.r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM b JOIN p USING (term) JOIN w USING (term) JOIN m ON m.r = p.r GROUP BY i, item_id, m.r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM e WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= {lexical.TOP_K}
"""

# Sharding. CRC-32 by bytes with its table; the jump sequence with 128-bit integers.
OP13_SQL = f"""
WITH RECURSIVE c(i, step, v) AS (SELECT i, 0, i::UBIGINT FROM range(256) t(i) UNION ALL
  SELECT i, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM c WHERE step < 8),
crc AS (SELECT list(v ORDER BY i) AS l FROM c WHERE step = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS raw,
        ('0x' || substr(md5(coalesce('k' || doc_id::VARCHAR, 'null')), 1, 15))::HUGEINT AS seed FROM documents),
j(r, n, key, here, nxt) AS (SELECT r, n, seed, -1::BIGINT, 0::BIGINT FROM d, (VALUES ({shards.SHARDS}), ({shards.SHARDS + 1})) AS s(n)
  UNION ALL SELECT r, n, k, nxt, floor((nxt + 1) * (2147483648.0::DOUBLE / ((k >> 33) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (key * {shards.MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k FROM j WHERE nxt < n)),
s AS (SELECT r, n, max(here) AS shard FROM j GROUP BY r, n),
x AS (SELECT d.*, xor(coalesce(list_reduce(
          list_transform(regexp_extract_all(hex(raw), '..'), lambda b: ('0x' || b)::UBIGINT),
          lambda a, b: xor(a >> 8, l[(xor(a, b) & 255)::INT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT),
          4294967295::UBIGINT)::BIGINT AS text_crc32 FROM d, crc)
SELECT doc_id, (octet_length(raw) + 1)::BIGINT AS size, text_crc32, 'key' AS law, a.shard::INT AS shard,
  row_number() OVER (PARTITION BY a.shard ORDER BY doc_id NULLS FIRST, text_crc32, octet_length(raw)) - 1 AS slot,
  g.shard::INT AS grown_shard
FROM x JOIN s a ON a.r = x.r AND a.n = {shards.SHARDS} JOIN s g ON g.r = x.r AND g.n = {shards.SHARDS + 1}
"""

ORACLE_SQL = {"op6_chat_format": OP6_SQL, "op8_quality_rules": OP8_SQL, "op9_warc": OP9_SQL, "op1_source_mix": OP1_SQL,
              "op12_lexical_search": OP12_SQL, "op13_jump_shards": OP13_SQL}

QUERIES = {f.__name__: f for f in (op1_source_mix, op2_phrase_fingerprints, op3_main_text, op4_lattice_score, op5_long_repeats, op6_chat_format, op7_simhash, op8_quality_rules, op9_warc,
                                  op10_bpe, op11_cross_alignment, op12_lexical_search, op13_jump_shards)}
