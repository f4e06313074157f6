"""SQL that gives the same rows as a query, where SQL can express it."""

from quillon.llm.chat import END, SEP, START

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

OP2 = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
apart AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () ELSE 0 END AS alone FROM said),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text) AS k FROM apart),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id, alone ORDER BY k) IS DISTINCT FROM role AS opens,
    length(text) + len(regexp_extract_all(text, '<\\\\*\\|')) AS escaped,
    length(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C')) AS named
  FROM placed)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(escaped) + sum(CASE WHEN opens THEN named + {len(START) + 1 + len(END) + 1} ELSE {len(SEP)} END))::BIGINT AS formatted_chars,
  count(*) FILTER (opens) AS n_blocks
FROM marked GROUP BY conv_id, alone"""

OP4 = f"""
WITH sized AS (SELECT doc_id, text, source, len({WORDS})::BIGINT AS size FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size) AS cap,
    [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM sized GROUP BY source),
total AS (SELECT sum(source_size)::DOUBLE AS words FROM per),
steps AS (
  SELECT a.cap / a.weight AS step, coalesce(sum(b.cap) FILTER (b.cap / b.weight < a.cap / a.weight), 0) AS below,
    sum(b.weight) FILTER (b.cap / b.weight >= a.cap / a.weight) AS open,
    sum(least(b.cap, a.cap / a.weight * b.weight)) AS reached
  FROM per a, per b GROUP BY a.source, a.cap, a.weight),
level AS (SELECT (words - below) / open AS level FROM steps, total WHERE reached >= words * (1 - 1e-12) ORDER BY step LIMIT 1),
targets AS (SELECT source, source_size, coalesce(least(cap, level * weight), cap) AS target FROM per LEFT JOIN level ON true),
drawn AS (
  SELECT doc_id, sized.source, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    list_sum(list_transform(range(8), lambda i: (strpos('0123456789abcdef', md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, ''))[i + 1]) - 1)::DOUBLE * pow(16, 7 - i))) / 4294967296.0 AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies
FROM (SELECT *, (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM drawn)"""

OP7 = f"""
WITH cut AS (SELECT doc_id, {WORDS} AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS s FROM cut WHERE len(ws) >= 20),
windows AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS said FROM starts),
later AS (SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY said ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS pos FROM later),
placed AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM cut),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS said
  FROM placed ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(said, '')) AS kept_sha256
FROM cut LEFT JOIN kept USING (doc_id)"""

OP11 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, payload, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS best FROM p),
b AS (SELECT *, list_reduce(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', hex[i]) - 1), 4, '0')), lambda x, y: x || y) AS bits FROM d)
SELECT page_id, payload_bytes,
  list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: substr(bits, (5 * i + j + 1)::BIGINT, 1)::INT * (16 >> j::INT)))::BIGINT, 1)), lambda x, y: x || y) AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM b"""

OP12 = """
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
said AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM cut),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM said GROUP BY lang),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM said, range(1, 6) AS sizes(k) WHERE len(ws) >= k),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a, i, array_to_string(string_split(c.phrase, ' ')[:i], ' ') AS one, array_to_string(string_split(c.phrase, ' ')[i + 1:], ' ') AS two
  FROM counts c, range(1, 5) AS places(i) WHERE c.k > 1 AND i < c.k),
scored AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, i, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN counts x ON x.lang = cuts.lang AND x.phrase = one JOIN counts y ON y.lang = cuts.lang AND y.phrase = two JOIN total ON total.lang = cuts.lang),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
inside AS (
  SELECT DISTINCT w.lang, w.phrase FROM worst w JOIN counts p ON p.lang = w.lang AND p.k > w.k AND contains(' ' || p.phrase || ' ', ' ' || w.phrase || ' ') AND 100 * p.f >= 100 * w.a),
placed AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM worst ANTI JOIN inside USING (lang, phrase))
SELECT * FROM placed WHERE rank <= 2000"""

OP13 = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS ts, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT *, len(ts)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM cut),
placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, array_to_string(ts[:i], '') AS prefix, array_to_string(ts[i + 1:j], '') AS middle, array_to_string(ts[j + 1:], '') AS suffix FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts"""

ORACLE = {"op2_chat_format": OP2, "op4_mixing": OP4, "op7_substring_dedup": OP7, "op11_warc": OP11, "op12_phrases": OP12, "op13_fill_in_middle": OP13}
