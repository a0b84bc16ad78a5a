"""DuckDB SQL for the registered queries that SQL can express: written against the meaning, not derived from the Spark plans."""

from __future__ import annotations

from folioflux.functions import money, text
from folioflux.plans import styles

WS, EDGE = text.WS, text.EDGE


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^[{WS}]+', ''), '[{WS}]+\z', '')"


def _collapse(x: str) -> str:
    return _strip(f"regexp_replace({x}, '[{WS}]+', ' ', 'g')")


def _words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{WS}]+'))"


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def _sha1(x: str) -> str:
    return f"sha1({x})"


def _any(x: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"


def _number(x: str) -> str:
    return f"('0x' || substr({x}, 1, 8))::BIGINT"


_LINES = "SELECT doc_id, source AS book_key, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents"
_SEG = f"""lines AS ({_LINES}),
placed AS (SELECT *, (dense_rank() OVER (PARTITION BY book_key ORDER BY doc_id) - 1)::INTEGER AS chapter_index, row_number() OVER (PARTITION BY book_key ORDER BY doc_id, line_no) - 1 AS position,
  first_value(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS chapter_title, {_strip('text')} AS t FROM lines),
seg AS (SELECT *, CASE WHEN t = '' THEN 'other' WHEN regexp_matches(t, '^[-*] ') THEN 'list_item' WHEN {_words('t')} <= 6 AND NOT regexp_matches(t, '[.!?]\\z') THEN 'heading' ELSE 'paragraph' END AS type,
  {_sha1("chapter_index || ':' || position || ':' || t")} AS id, {_sha1('t')} AS segment_hash FROM placed),
seg2 AS (SELECT *, CASE WHEN type = 'heading' THEN CASE WHEN line_no = 0 THEN 1 ELSE 2 END END AS heading_level FROM seg)"""
_STATE = f"""{_SEG},
hit AS (SELECT DISTINCT book_key, segment_hash FROM seg WHERE {_number('segment_hash')} % 7 = 0),
st AS (SELECT seg.*, CASE WHEN t = '' THEN 'empty' WHEN {_number('id')} % 11 = 0 THEN 'skip' WHEN h.segment_hash IS NOT NULL THEN 'cached' ELSE 'work' END AS state FROM seg LEFT JOIN hit h USING (book_key, segment_hash))"""
_BATCH = f"""{_STATE},
br AS (SELECT *, CASE WHEN state = 'work' AND lag(state) OVER w = 'work' AND lag(chapter_index) OVER w = chapter_index THEN 0 ELSE 1 END AS brk FROM st WINDOW w AS (PARTITION BY book_key ORDER BY position)),
isl AS (SELECT *, sum(brk) OVER (PARTITION BY book_key ORDER BY position) AS island, sum(CASE WHEN state = 'cached' THEN 1 ELSE 0 END) OVER (PARTITION BY book_key ORDER BY position) AS epoch FROM br),
slots AS (SELECT *, (row_number() OVER (PARTITION BY book_key, island ORDER BY position) - 1) // 20 AS part FROM isl WHERE state = 'work'),
ba AS (SELECT book_key, chapter_index, island, part, min(epoch) AS epoch, min(position) AS first_position, max(position) AS last_position, count(*) AS n_segments, string_agg(id, ',' ORDER BY position) AS ids,
  string_agg('[[' || rn || ']] ' || text, chr(10) || chr(10) ORDER BY position) AS body
  FROM (SELECT *, row_number() OVER (PARTITION BY book_key, island, part ORDER BY position) AS rn FROM slots) GROUP BY ALL),
bn AS (SELECT *, row_number() OVER (PARTITION BY book_key ORDER BY first_position) - 1 AS batch_no, (row_number() OVER (PARTITION BY book_key, epoch ORDER BY first_position) - 1) // 4 AS wave_in_epoch FROM ba),
wv AS (SELECT *, dense_rank() OVER (PARTITION BY book_key ORDER BY epoch, wave_in_epoch) - 1 AS wave_no, min(first_position) OVER (PARTITION BY book_key, epoch, wave_in_epoch) AS wave_first FROM bn)"""

_EST = f"""{_SEG}, ch AS (SELECT book_key, chapter_index, count(*) AS n_segments, sum(length(t)) AS chars FROM seg WHERE t <> '' AND NOT {_any(f"lower({_strip('chapter_title')})", text.SKIPPABLE_TITLES)} GROUP BY ALL),
tok AS (SELECT *, ceil(n_segments / 20)::BIGINT AS b, (chars // 4)::BIGINT AS s, floor((chars // 4) * 1.1::DOUBLE)::BIGINT AS g FROM ch),
est AS (SELECT book_key, chapter_index, n_segments, 2 * b AS calls, (s + 400 * b + s + g + 400 * b)::BIGINT AS input_tokens, (2 * g + 2 * b * 464)::BIGINT AS output_tokens FROM tok)"""
_COST = "(input_tokens::DOUBLE / 1000000 * 0.25 + output_tokens::DOUBLE / 1000000 * 2.0) * 0.92"

_PAGE = f"""ln AS (SELECT book_key, doc_id::INTEGER AS page_index, line_no, text, max(line_no) OVER (PARTITION BY doc_id) AS last FROM ({_LINES})),
pl AS (SELECT *, CASE WHEN line_no = 0 THEN 10.0 WHEN line_no = last THEN 790.0 ELSE 90.0 + line_no * 12.0 + CASE WHEN length(text) % 9 = 0 THEN 30.0 ELSE 0.0 END END::DOUBLE AS y0,
  CASE WHEN length(text) % 13 = 0 THEN 18.0 ELSE 10.0 + length(text) % 3 END::DOUBLE AS size, (50.0 + CASE WHEN length(text) % 5 = 0 THEN 15.0 ELSE 0.0 END + page_index % 2 * 4)::DOUBLE AS x0,
  lower(regexp_replace(text, '[^\\p{{L}}\\p{{M}}_]', '', 'g')) AS head_key FROM ln),
pb AS (SELECT *, (y0 < 64.0 OR y0 > 736.0) AS in_band FROM pl)"""

_TEXTS = f"tx AS (SELECT doc_id, line_no, text, {_strip('text')} AS t, CASE WHEN line_no = 0 THEN 20.0 ELSE 12.0 END AS size FROM ({_LINES}))"
_PAGENO = r"(regexp_matches(t, '^\p{Nd}+\.?\z') OR regexp_matches(t, '^[ivxlcdmIVXLCDM]+\z'))"
_DIGIT = rf"regexp_matches(t, '^[^{WS}]*\p{{Nd}}[^{WS}]*\z')"
_GARBLED = rf"({_DIGIT} AND len(list_filter(regexp_extract_all(t, '\p{{L}}+'), lambda r: length(r) > 2 AND NOT regexp_matches(r, '^[ivxlcdmIVXLCDM]+\z'))) = 0)"
_EMPTY = r"NOT regexp_matches(t, '[\p{L}\p{M}\p{N}_]')"
_URI = rf"regexp_matches(lower(t), '^(https?|ftp)://[^{WS}]+\z')"
_HEAD_KEY = r"lower(regexp_replace(t, '[^\p{L}\p{M}_]', '', 'g'))"
_CLOSED = rf"regexp_replace(regexp_replace(regexp_replace(text, '[{WS}]+\z', ''), '[{text.CLOSERS.replace(chr(39), chr(39) * 2)}]+\z', ''), '[{WS}]+\z', '')"
_ALPHA = r"regexp_extract_all(text, '\p{L}+')"
_TITLE_CASED = rf"(len({_ALPHA}) >= 2 AND len(list_filter({_ALPHA}, lambda x: regexp_matches(x, '^\p{{Lu}}'))) >= 0.6 * len({_ALPHA}))"
_ODD = f"len(list_filter({_ALPHA}, lambda x: (length(x) >= 2 AND NOT regexp_matches(lower(x), '[aeiouy]')) OR regexp_matches(lower(x), '{text.VOWEL_RUN}') OR regexp_matches(lower(x), '{text.CONSONANT_RUN}')))"
_WORDLIKE = f"({_ODD} = 0 AND NOT (len({_ALPHA}) > 0 AND len(list_filter({_ALPHA}, lambda x: length(x) <= 3)) > 0.5 * len({_ALPHA})))"
_TOKENS = f"regexp_extract_all(text, '[^{WS}]+')"
_REAL = rf"len(list_filter(list_transform({_TOKENS}, lambda x: lower(regexp_replace(x, '\P{{L}}', '', 'g'))), lambda x: length(x) >= 4 AND regexp_matches(x, '[aeiouy]') AND NOT regexp_matches(x, '{text.VOWEL_RUN}') AND NOT regexp_matches(x, '{text.CONSONANT_RUN}')))"


def _label(x: str, options: tuple[str, ...]) -> str:
    return rf"regexp_matches(lower({x}), '^({'|'.join(options)})([^\p{{L}}\p{{N}}_]|\z)')"


_NUMBERED = rf"regexp_matches(t, '^\p{{Nd}}{{1,3}}[.)][{WS}]+[^{WS}]')"
_BACK_KEY = f"({_HEAD_KEY} <> '' AND ({_any(_HEAD_KEY, text.BACK_KEY_PARTS)} OR " + " OR ".join(f"starts_with({_HEAD_KEY}, '{p}')" for p in text.BACK_KEY_STARTS) + "))"
_NAME = r"[A-Z][\p{L}\p{N}_.''\x{2019}-]*"
_CAPTION = rf"""(({_words('t')} <= 12 AND ((starts_with(t, '(') AND ends_with(t, ')')) OR regexp_matches(t, '\([^)]{{2,}}\)[{WS}]*\z')))
  OR ({_words('t')} <= 40 AND (regexp_matches(t, '\({_NAME}([{WS}]+{_NAME}){{0,3}}\)[{WS}]*\z') OR regexp_matches(lower(t), '\(({'|'.join(text.PLACES_IN_PHOTO)})\)') OR regexp_matches(t, '^({'|'.join(text.DEPICTIONS)}) of([^\p{{L}}\p{{N}}_]|\z)'))))"""
_INCOMPLETE = rf"({_CLOSED} <> '' AND NOT regexp_matches({_CLOSED}, '[.!?\x{{2026}}]\z'))"
_SCENE = rf"""({_words('t')} <= 6 AND {_INCOMPLETE} AND (regexp_matches(t, '^({'|'.join(text.MONTHS)})([{WS}]+\p{{Nd}}{{1,2}},?)?[{WS}]+\p{{Nd}}{{4}}\z') OR regexp_matches(t, '^{_NAME}([{WS}]+{_NAME}){{0,2}},[{WS}]+[A-Z][\p{{L}}\p{{N}}_.''\x{{2019}} -]+\z')))"""

_PAIRS = "cv AS (SELECT conv_id AS book_key, turn AS position, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), pr AS (SELECT book_key, position, text, CASE WHEN nr = 'assistant' THEN nt END AS target_text FROM cv WHERE role = 'user')"
_VERDICT = "vd AS (SELECT l.doc_id, source, lang, quality, toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE quality IS NOT NULL AND toxic IS NOT NULL)"
_SAMPLE = f"{_VERDICT}, sm AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM vd)"


def _draws(seed: int, resamples: int) -> str:
    return f"""sz AS (SELECT source, count(*) AS n FROM sm GROUP BY source),
dr AS (SELECT source, r, d, {_number(f"sha1('{seed}:' || r || ':' || d)")} % n AS idx FROM (SELECT source, n, r, unnest(range(n)) AS d FROM (SELECT source, n, unnest(range({resamples})) AS r FROM sz)))"""


_STRUCT = f"""{_SEG}, tg AS (SELECT * FROM seg2 WHERE position % 17 <> 0),
a AS (SELECT book_key, count(DISTINCT chapter_index) AS c, count(*) FILTER (type = 'heading') AS h, count(*) FILTER (type = 'list_item') AS l, count(*) FILTER (type = 'blockquote') AS q, sum(len(regexp_extract_all(lower(text), '<(em|strong|i|b)>'))) AS e FROM seg2 GROUP BY 1),
b AS (SELECT book_key, count(DISTINCT chapter_index) AS c, count(*) FILTER (type = 'heading') AS h, count(*) FILTER (type = 'list_item') AS l, count(*) FILTER (type = 'blockquote') AS q, sum(len(regexp_extract_all(lower(text), '<(em|strong|i|b)>'))) AS e FROM tg GROUP BY 1),
m AS (SELECT book_key, sum(least(x.n, y.n)) AS m FROM (SELECT book_key, heading_level AS v, count(*) AS n FROM seg2 WHERE type = 'heading' GROUP BY ALL) x JOIN (SELECT book_key, heading_level AS v, count(*) AS n FROM tg WHERE type = 'heading' GROUP BY ALL) y USING (book_key, v) GROUP BY 1),
t5 AS (SELECT a.book_key, (CASE WHEN a.c = 0 AND b.c = 0 THEN 1 ELSE least(a.c, b.c)::DOUBLE / greatest(a.c, b.c) END) * 2.5::DOUBLE AS chapter_score,
  (CASE WHEN greatest(a.h, b.h) = 0 THEN 1 ELSE coalesce(m.m, 0)::DOUBLE / greatest(a.h, b.h) END) * 2.5::DOUBLE AS heading_score,
  ((CASE WHEN a.l = 0 AND b.l = 0 THEN 1 ELSE least(a.l, b.l)::DOUBLE / greatest(a.l, b.l) END) + (CASE WHEN a.q = 0 AND b.q = 0 THEN 1 ELSE least(a.q, b.q)::DOUBLE / greatest(a.q, b.q) END)) / 2 * 2.5::DOUBLE AS block_score,
  (CASE WHEN a.e = 0 OR least(a.e, b.e)::DOUBLE / a.e >= 0.95 THEN 1 ELSE least(a.e, b.e)::DOUBLE / a.e END) * 2.5::DOUBLE AS emphasis_score FROM a JOIN b USING (book_key) LEFT JOIN m USING (book_key))"""
_T7 = f"w AS (SELECT book_key, sum({_words('text')})::BIGINT AS n_words, sum(length(text)) AS n_chars FROM ({_LINES}) GROUP BY 1), t7 AS (SELECT book_key, n_words, CASE WHEN n_words <= 0 THEN 1.0 ELSE greatest(0.0, least(1.0, (4.5 - n_chars * 4e-6 / (n_words / 100000)) / 3.0)) END::DOUBLE AS fraction FROM w)"

_RUNS = f"""{_SEG}, ct AS (SELECT *, (position % 13 <> 5) AS known, (type = 'paragraph' AND t <> '' AND position % 13 <> 5) AS fit FROM seg),
eb AS (SELECT *, sum(CASE WHEN fit AND lag_fit AND lag_ch = chapter_index THEN 0 ELSE 1 END) OVER (PARTITION BY book_key ORDER BY position) AS block FROM (SELECT *, coalesce(lag(fit) OVER w, false) AS lag_fit, lag(chapter_index) OVER w AS lag_ch FROM ct WINDOW w AS (PARTITION BY book_key ORDER BY position))),
tl AS (SELECT *, row_number() OVER (PARTITION BY book_key, block ORDER BY position) - 1 AS nth FROM eb WHERE fit),
rn AS (SELECT *, nth % 5 AS slot, min(position) OVER (PARTITION BY book_key, block, nth // 5) AS run, count(*) FILTER (nth % 5 < 3) OVER (PARTITION BY book_key, block, nth // 5) AS full_n FROM tl),
ru AS (SELECT book_key, chapter_index, run, slot, position, segment_hash FROM rn WHERE slot < 3 AND full_n = 3)"""
_TITLE = f"lower({_strip('chapter_title')})"
_ELIGIBLE = f"""{_SEG}, fl AS (SELECT DISTINCT book_key, chapter_index FROM seg WHERE {_any(_TITLE, text.FRONT_TITLES + text.BACK_TITLES)}),
cd AS (SELECT book_key AS book_slug, chapter_index, position, id, segment_hash, text, {_words('text')} AS words FROM seg ANTI JOIN fl USING (book_key, chapter_index) WHERE type = 'paragraph' AND {_words('text')} >= 15),
cb AS (SELECT *, CASE WHEN words >= 80 THEN 'long' WHEN words >= 35 THEN 'medium' ELSE 'short' END AS band FROM cd)"""
_STRATA_LIST = "list_filter([" + ", ".join(f"CASE WHEN {_has('text', p)} THEN '{n}' END" for n, p in text.STRATA.items()) + "], lambda x: x IS NOT NULL)"
_LOG = "lg AS (SELECT user_id, event_type, event_id AS arrival, floor(epoch(ts) / 3600)::BIGINT - CASE WHEN event_id % 11 = 0 THEN 24 ELSE 0 END AS updated_at, CASE WHEN event_id % 7 = 0 THEN 'undelete' WHEN event_id % 5 = 0 THEN 'delete' ELSE 'upsert' END AS op, value FROM events)"
_HOST = "regexp_extract(url, '^[a-z]+://([^/]+)', 1)"
_SPINE = f"sp AS (SELECT {_HOST} AS book_key, page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)"
_UNSAFE = r"""[\x{00}-\x{1F}\x{7F}<>:"/\\|?*]"""
_PUBLIC = "pub AS (SELECT o.* FROM orders o SEMI JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey WHERE o_totalprice > 100000)"
_MODELS = sorted(money.PRICES)


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["segment_identity"] = f"WITH {_SEG} SELECT book_key, chapter_index, position, id, segment_hash FROM seg"
    q["book_hash"] = f"WITH {_SEG} SELECT book_key, sha1(string_agg(id, chr(10) ORDER BY position)) AS book_hash, count(*) AS n_segments FROM seg GROUP BY 1"
    q["segment_inventory"] = f"""WITH {_SEG} SELECT book_key, count(*) AS n_segments, count(DISTINCT chapter_index) AS n_chapters, count(*) FILTER (t = '') AS n_blank, count(*) FILTER (type = 'heading') AS n_heading,
      count(*) FILTER (type = 'paragraph') AS n_paragraph, count(*) FILTER (type = 'list_item') AS n_list_item, count(*) FILTER (type = 'other') AS n_other, sum({_words('text')})::BIGINT AS n_words FROM seg GROUP BY 1"""
    q["batch_plan"] = f"WITH {_BATCH} SELECT book_key, batch_no, chapter_index, first_position, last_position, n_segments, sha1(ids) AS ids_sha1 FROM bn"
    q["wave_plan"] = f"WITH {_BATCH} SELECT book_key, batch_no, wave_no, wave_first, n_segments FROM wv"
    q["wave_context"] = f"""WITH {_BATCH}, ws AS (SELECT DISTINCT book_key, wave_no, wave_first FROM wv), rm AS (SELECT book_key, position, id FROM st WHERE state IN ('cached', 'work')),
      cx AS (SELECT ws.*, rm.position, rm.id, row_number() OVER (PARTITION BY ws.book_key, wave_no ORDER BY rm.position DESC) AS back FROM ws LEFT JOIN rm ON rm.book_key = ws.book_key AND rm.position < ws.wave_first)
      SELECT book_key, wave_no, wave_first, coalesce(string_agg(id, ',' ORDER BY position), '') AS context FROM cx WHERE back <= 2 GROUP BY 1, 2, 3"""
    q["batch_prompt_text"] = f"""WITH {_BATCH}, p AS (SELECT book_key, batch_no, 'Translate into: sl.' || chr(10) || chr(10) || 'Translate each of the following numbered segments. Reply with each segment''s marker followed by its translation:' || chr(10) || chr(10) || body AS prompt FROM bn)
      SELECT book_key, batch_no, length(prompt)::BIGINT AS n_chars, sha1(prompt) AS prompt_sha1 FROM p"""
    q["rolling_context"] = f"""WITH {_PAIRS}, x AS (SELECT book_key, position, 'SOURCE: ' || text || chr(10) || 'TRANSLATION: ' || target_text AS line FROM pr WHERE target_text IS NOT NULL)
      SELECT book_key, position, sha1(concat_ws(chr(10) || chr(10), lag(line, 2) OVER w, lag(line) OVER w)) AS context_sha1 FROM x WINDOW w AS (PARTITION BY book_key ORDER BY position)"""
    q["cost_estimate_by_chapter"] = f"WITH {_EST} SELECT *, round({_COST}, 9) AS cost_eur FROM est"
    q["cost_estimate_total"] = f"""WITH {_EST}, s AS (SELECT book_key, sum(n_segments)::BIGINT AS n_segments, sum(calls)::BIGINT + 2 AS calls, sum(input_tokens)::BIGINT + 3000 + 1500 AS input_tokens, sum(output_tokens)::BIGINT + 300 + 464 + 200 + 464 AS output_tokens FROM est GROUP BY 1)
      SELECT *, round({_COST}, 6) AS cost_eur FROM s"""
    q["mt_cost"] = f"SELECT book_key, sum(length({_strip('text')}))::BIGINT AS n_chars, round(sum(length({_strip('text')}))::DOUBLE / 1000000 * 20 * 0.92, 6) AS cost_eur FROM ({_LINES}) GROUP BY 1"
    q["calls_rollup"] = "SELECT o_orderpriority AS model, l_returnflag AS kind, count(*) AS n_calls, sum(l_quantity::BIGINT)::BIGINT AS input_tokens, sum(l_linenumber)::BIGINT AS output_tokens, round(sum(l_extendedprice / 1e6), 6) AS cost_eur FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"
    price = " ".join(f"WHEN {i} THEN struct_pack(m := '{m}', i := {money.PRICES[m][0]}::DOUBLE, o := {money.PRICES[m][1]}::DOUBLE)" for i, m in enumerate(_MODELS))
    q["call_prices"] = f"""WITH x AS (SELECT CASE l_linenumber % {len(_MODELS)} {price} END AS p, (l_quantity * 1000)::BIGINT AS ti, (l_quantity * 100)::BIGINT AS tout FROM lineitem)
      SELECT p.m AS model, count(*) AS n_calls, round(sum((ti / 1000000 * p.i + tout / 1000000 * p.o) * 0.92), 4) AS cost_eur FROM x GROUP BY 1"""
    q["latest_memo"] = "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"
    q["insert_or_ignore"] = f"""WITH d AS (SELECT doc_id, sha1({_strip('text')}) AS segment_hash FROM documents), o AS (SELECT segment_hash FROM d WHERE doc_id % 3 = 0 UNION SELECT sha1({_strip('text')}) FROM benchmark)
      SELECT segment_hash, min(doc_id) AS doc_id FROM d WHERE segment_hash NOT IN (SELECT segment_hash FROM o) GROUP BY 1"""
    q["cache_hit_rate"] = f"""WITH {_STATE}, c AS (SELECT book_key, count(*) FILTER (state = 'empty') AS n_empty, count(*) FILTER (state = 'skip') AS n_skip, count(*) FILTER (state = 'cached') AS n_cached, count(*) FILTER (state = 'work') AS n_work FROM st GROUP BY 1)
      SELECT *, round(n_cached::DOUBLE / (n_cached + n_work), 9) AS hit_rate FROM c"""
    heads = f"{_PAGE}, rh AS (SELECT book_key, head_key, count(DISTINCT page_index) AS n_pages FROM pb WHERE in_band AND head_key <> '' GROUP BY 1, 2 HAVING count(DISTINCT page_index) >= 3)"
    q["running_heads"] = f"WITH {heads} SELECT * FROM rh"
    q["strip_furniture"] = f"""WITH {heads}, x AS (SELECT pb.*, {_strip('text')} AS t, rh.n_pages FROM pb LEFT JOIN rh USING (book_key, head_key))
      SELECT book_key, count(*) AS n_lines, count(*) FILTER (in_band) AS n_in_band, sum(length(text))::BIGINT AS n_chars FROM x WHERE NOT (in_band AND ({_PAGENO} OR head_key = '' OR n_pages IS NOT NULL OR {_GARBLED} OR {_URI})) GROUP BY 1"""
    q["body_size"] = f"WITH {_PAGE} SELECT book_key, coalesce(median(size) FILTER (size > 0), 12.0) AS body_size FROM pb GROUP BY 1"
    q["median_gap"] = f"""WITH {_PAGE}, g AS (SELECT book_key, page_index, y0 - lag(y0) OVER (PARTITION BY book_key, page_index ORDER BY line_no) AS step FROM pb)
      SELECT book_key, page_index, coalesce(median(step) FILTER (step > 0), 0.0) AS page_gap FROM g GROUP BY 1, 2"""
    q["modal_margin"] = f"""WITH {_PAGE}, e AS (SELECT book_key, page_index % 2 AS parity, round_even(x0, 0) AS margin, page_index, line_no FROM pb),
      c AS (SELECT book_key, parity, margin, count(*) AS n, min((page_index, line_no)) AS f FROM e GROUP BY 1, 2, 3), w AS (SELECT book_key, margin, sum(n) AS n, min(f) AS f FROM c GROUP BY 1, 2),
      whole AS (SELECT book_key, margin FROM w QUALIFY row_number() OVER (PARTITION BY book_key ORDER BY n DESC, f) = 1), own AS (SELECT book_key, parity, margin FROM c QUALIFY row_number() OVER (PARTITION BY book_key, parity ORDER BY n DESC, f) = 1)
      SELECT whole.book_key, p.parity::INTEGER AS parity, coalesce(own.margin, whole.margin) AS margin FROM whole CROSS JOIN (VALUES (0), (1)) p(parity) LEFT JOIN own ON own.book_key = whole.book_key AND own.parity = p.parity"""
    q["dehyphenate_pairs"] = rf"""WITH x AS (SELECT doc_id, line_no::INTEGER AS line_no, substr(text, 1, (length(text) + 1) // 2) AS a, substr(text, (length(text) + 1) // 2 + 1) AS b FROM ({_LINES})),
      y AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(a, '\p{{L}}\z') AND regexp_matches(b, '^\p{{L}}') THEN a || CASE WHEN regexp_matches(b, '^\p{{Lu}}') THEN '-' ELSE '' END || b ELSE '-' END AS j FROM x)
      SELECT doc_id, line_no, length(j)::BIGINT AS n_chars, sha1(j) AS joined_sha1 FROM y"""
    q["line_shapes"] = rf"""WITH {_TEXTS} SELECT doc_id, line_no::INTEGER AS line_no, {_TITLE_CASED} AS title_cased, {_WORDLIKE} AS wordlike, (len({_TOKENS}) = 0 OR {_REAL} < greatest(1.0, 0.25 * len({_TOKENS}))) AS gibberish, {_INCOMPLETE} AS incomplete,
      regexp_matches(text, '^\P{{L}}*\p{{Ll}}') AS lowercase, {_PAGENO} AS page_number, {_GARBLED} AS garbled, ({_EMPTY} OR {_PAGENO} OR {_DIGIT}) AS droppable, {_EMPTY} AS contentless FROM tx"""
    strong = rf"({_label('text', text.CHAPTER_LABELS)} OR {_NUMBERED} OR (size >= 17.4 AND {_words('text')} BETWEEN 2 AND 12 AND len(regexp_extract_all(text, '\p{{Nd}}')) <= 2 AND NOT regexp_matches(text, '[=<>\x{{A9}}\x{{AE}}+&~|/\\{{}}\[\]]') AND NOT regexp_matches(text, '[.!?]\z') AND {_TITLE_CASED} AND {_WORDLIKE}))"
    q["heading_candidates"] = rf"""WITH {_TEXTS} SELECT doc_id, line_no::INTEGER AS line_no, CASE WHEN size >= 22.8 THEN 1 ELSE 2 END AS level, {strong} AS strong, {_HEAD_KEY} AS head_key FROM tx
      WHERE {_words('t')} BETWEEN 1 AND 12 AND NOT regexp_matches(t, '[,;:]\z') AND regexp_matches(t, '\p{{L}}{{3,}}') AND (size >= 17.4 OR ({_words('t')} <= 6 AND NOT regexp_matches(t, '[.!?]\z') AND ({_label('t', text.HEADING_WORDS)} OR {_NUMBERED} OR {_BACK_KEY})))"""
    turns = f"""CASE (doc_id + line_no) % 6 WHEN 0 THEN text WHEN 1 THEN '(' || substr(text, 1, 30) || ')' WHEN 2 THEN '{text.DEPICTIONS[0]} of ' || substr(text, 1, 40) WHEN 3 THEN '{text.MONTHS[0]} 12, 1944' WHEN 4 THEN 'Ljubljana, Slovenia'
      ELSE substr(text, 1, 40) || ' (John Smith)' END"""
    q["captions"] = f"""WITH vr AS (SELECT doc_id, line_no, {turns} AS text FROM ({_LINES})), tx AS (SELECT *, {_strip('text')} AS t FROM vr) SELECT doc_id, line_no::INTEGER AS line_no, {_CAPTION} AS caption, {_SCENE} AS scene FROM tx WHERE {_CAPTION} OR {_SCENE}"""
    q["toc_chapter_assign"] = "SELECT e.event_id, s.event_id AS start_id FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_id % 40 = 0) s ON e.user_id = s.user_id AND e.ts >= s.ts"
    q["caption_band_join"] = rf"""WITH {_PAGE}, b AS (SELECT * FROM pb WHERE NOT in_band), im AS (SELECT * FROM b WHERE line_no % 10 = 3), mk AS (SELECT * FROM b WHERE line_no % 7 = 1 OR contains(text, '('))
      SELECT im.book_key, im.page_index, im.line_no::INTEGER AS line_no, min(mk.line_no)::INTEGER AS caption_no FROM im JOIN mk ON im.book_key = mk.book_key AND im.page_index = mk.page_index AND mk.y0 BETWEEN im.y0 - 48 AND im.y0 + 48 GROUP BY 1, 2, 3 HAVING count(*) = 1"""
    from folioflux.queries import _MATTER

    listed = "[" + ", ".join(f"'{x}'" for x in _MATTER) + "]"
    name = f"{listed}[(doc_id % {len(_MATTER)} + 1)::INTEGER]"
    title = f"CASE WHEN doc_id % 3 = 0 THEN ' ' || upper({name}) || ' 2' ELSE {name} END"
    q["back_front_matter"] = f"WITH {_SEG}, x AS (SELECT book_key, chapter_index, {title} AS ti FROM seg) SELECT DISTINCT book_key, chapter_index FROM x WHERE {_any(f'lower({_strip("ti")})', text.FRONT_TITLES + text.BACK_TITLES)}"
    key, low = r"lower(regexp_replace(ti, '[^\p{L}\p{M}_]', '', 'g'))", f"lower({_strip('ti')})"
    starts = lambda parts: "(" + " OR ".join(f"starts_with({key}, '{p}')" for p in parts) + ")"
    q["matter_titles"] = rf"""WITH x AS (SELECT doc_id, {title} AS ti FROM documents) SELECT doc_id, {_any(low, text.FRONT_TITLES)} AS front, {_any(low, text.BACK_TITLES)} AS back, {_any(low, text.SKIPPABLE_TITLES)} AS skippable,
      ({key} <> '' AND ({_any(key, text.BACK_KEY_PARTS)} OR {starts(text.BACK_KEY_STARTS)})) AS back_key, (NOT regexp_matches(ti, '[\p{{L}}\p{{M}}\p{{N}}_]') OR ({key} <> '' AND ({key} IN {text.FRONT_KEYS} OR {starts(text.FRONT_KEY_STARTS)}))) AS front_key FROM x"""
    q["eligible_matter"] = f"""WITH {_SEG}, x AS (SELECT book_key, chapter_index, type, {_words('text')} AS words, {title} AS ti FROM seg), fl AS (SELECT DISTINCT book_key, chapter_index FROM x WHERE {_any(low, text.FRONT_TITLES + text.BACK_TITLES)})
      SELECT book_key, CASE WHEN words >= 80 THEN 'long' WHEN words >= 35 THEN 'medium' ELSE 'short' END AS band, count(*) AS n, sum(words)::BIGINT AS words FROM x ANTI JOIN fl USING (book_key, chapter_index) WHERE type = 'paragraph' AND words >= 15 GROUP BY 1, 2"""
    q["body_pool_fallback"] = f"""WITH {_SEG}, r AS (SELECT book_key, count(*) FILTER (chapter_index % 3 <> 0) >= 120 AS restricted FROM seg GROUP BY 1)
      SELECT book_key, restricted, count(*) AS n FROM seg JOIN r USING (book_key) WHERE NOT restricted OR chapter_index % 3 <> 0 GROUP BY 1, 2"""
    from folioflux.sources.html import VOID

    void = "|".join(VOID)
    q["xhtml_repair"] = rf"""WITH a AS (SELECT page_id, regexp_replace(html, '^\s*<\?xml[^>]*\?>', '') AS h FROM pages),
      b AS (SELECT page_id, regexp_replace(replace(regexp_replace(h, '&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)', chr(1) || '\1', 'g'), '&', '&amp;'), chr(1), '&', 'g') AS h FROM a),
      c AS (SELECT page_id, regexp_replace(h, '(?i)<((?:{void})(?:(?:[\s/](?:"[^"]*"|''[^'']*''|[^<>"''])*)?(?:"[^"]*"|''[^'']*''|[^<>"''/])|))>', '<\1/>', 'g') AS h FROM b)
      SELECT page_id, length(h)::BIGINT AS n_chars, sha1(h) AS repaired_sha1 FROM c"""
    q["title_forward_fill"] = f"WITH {_SPINE} SELECT book_key, page_id, coalesce(last_value(CASE WHEN page_id % 4 = 0 THEN title END IGNORE NULLS) OVER (PARTITION BY book_key ORDER BY page_id ROWS UNBOUNDED PRECEDING), title) AS chapter_title FROM sp"
    q["title_collapse_share"] = f"""WITH {_SPINE}, c AS (SELECT book_key, CASE WHEN page_id % 4 = 0 THEN title ELSE 'Untitled' END AS title, count(*) AS n FROM sp GROUP BY 1, 2), s AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY book_key) AS share FROM c)
      SELECT book_key, title, round(share, 9) AS share, share >= 0.5 AS collapsed FROM s QUALIFY row_number() OVER (PARTITION BY book_key ORDER BY n DESC, title DESC) = 1"""
    q["furniture_resources"] = f"""WITH l AS (SELECT book_key, page_id, unnest(h) AS href, (generate_subscripts(h, 1) - 1)::INTEGER AS nth FROM (SELECT {_HOST} AS book_key, page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)),
      c AS (SELECT *, count(*) OVER (PARTITION BY book_key, href) AS n, row_number() OVER (PARTITION BY book_key, href ORDER BY page_id, nth) AS seen FROM l) SELECT book_key, page_id, nth, href FROM c WHERE n < 3 OR seen = 1"""
    q["completeness_t1"] = f"WITH {_PAIRS} SELECT book_key, count(*) AS n_source, count(*) FILTER ({_strip('target_text')} <> '') AS n_done, round(count(*) FILTER ({_strip('target_text')} <> '')::DOUBLE / count(*), 9) AS fraction FROM pr GROUP BY 1"
    q["structure_t5"] = f"WITH {_STRUCT} SELECT book_key, round(chapter_score, 9) AS chapter_score, round(heading_score, 9) AS heading_score, round(block_score, 9) AS block_score, round(emphasis_score, 9) AS emphasis_score, round((chapter_score + heading_score + block_score + emphasis_score) / 10, 9) AS fraction FROM t5"
    spaced = r"regexp_replace(lower(pr.text), '([^\p{L}\p{N}_])', '\1\1', 'g')"
    q["terminology_t4"] = rf"""WITH {_PAIRS}, g AS (SELECT DISTINCT lower(regexp_extract(text, '^(\p{{L}}+)', 1)) AS term FROM benchmark WHERE regexp_extract(text, '^(\p{{L}}+)', 1) <> ''),
      o AS (SELECT g.term, len(regexp_extract_all({spaced}, '{EDGE[0]}' || g.term || '{EDGE[1]}')) AS n, regexp_matches(lower(pr.target_text), '{EDGE[0]}' || substr(g.term, 1, greatest(3, length(g.term) - 2)::BIGINT)) AS hit FROM pr, g WHERE pr.target_text IS NOT NULL),
      t AS (SELECT term, sum(n) AS n, sum(CASE WHEN hit THEN n ELSE 0 END) AS m FROM o WHERE n > 0 GROUP BY 1 ORDER BY n DESC, term LIMIT 20)
      SELECT coalesce(sum(n), 0)::BIGINT AS n_occurrences, coalesce(sum(m), 0)::BIGINT AS n_matched, round(CASE WHEN coalesce(sum(n), 0) = 0 THEN 1.0 ELSE sum(m)::DOUBLE / sum(n) END, 9) AS fraction FROM t"""
    q["cost_t7"] = f"WITH {_T7} SELECT book_key, n_words, round(fraction, 9) AS fraction FROM t7"
    q["weighted_total"] = f"""WITH {_STRUCT}, {_T7}, k AS (SELECT book_key, avg(CASE WHEN position % 17 <> 0 THEN 1.0 ELSE 0.0 END) AS f FROM seg GROUP BY 1), t1 AS (SELECT book_key, CASE WHEN f > 0.941 THEN 1.0 ELSE f END AS f FROM k),
      s AS (SELECT t1.book_key, t1.f, (t1.f * 20 + (chapter_score + heading_score + block_score + emphasis_score) / 10 * 10 + t7.fraction * 5) / 35 * 100 AS total FROM t1 JOIN t5 USING (book_key) JOIN t7 USING (book_key))
      SELECT book_key, round(CASE WHEN f < 1 THEN least(total, 40) ELSE total END, 7) AS total FROM s"""
    q["bilingual_mismatch"] = f"WITH {_SEG} SELECT book_key, min(position) AS first_position, count(*) AS n FROM seg WHERE position % 101 = 100 OR position % 53 = 7 GROUP BY 1"
    q["seeded_sample"] = f"WITH {_VERDICT} SELECT source, doc_id, quality FROM vd QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha1('42:' || doc_id)) <= 10"
    q["bootstrap_ci"] = f"""WITH {_SAMPLE}, {_draws(42, 2000)}, rs AS (SELECT dr.source, r, avg(quality::DOUBLE) AS v FROM dr JOIN sm ON dr.source = sm.source AND dr.idx = sm.idx GROUP BY 1, 2)
      SELECT source, round(quantile_cont(v, 0.025), 9) AS ci_low, round(quantile_cont(v, 0.975), 9) AS ci_high FROM rs GROUP BY 1"""
    q["joint_bootstrap_total"] = f"""WITH {_SAMPLE}, {_draws(7, 2000)}, rs AS (SELECT dr.source, r, (avg(quality::DOUBLE) * 30 + avg(toxic::DOUBLE) * 20) / 50 * 100 AS v FROM dr JOIN sm ON dr.source = sm.source AND dr.idx = sm.idx GROUP BY 1, 2)
      SELECT source, round(quantile_cont(v, 0.025), 7) AS ci_low, round(quantile_cont(v, 0.975), 7) AS ci_high FROM rs GROUP BY 1"""
    q["cluster_bootstrap_ci"] = f"""WITH {_VERDICT}, c AS (SELECT row_number() OVER (ORDER BY source) - 1 AS idx, total, n FROM (SELECT source, sum(quality)::DOUBLE AS total, count(*) AS n FROM vd GROUP BY 1)),
      d AS (SELECT r, {_number("sha1('42:' || r || ':' || d)")} % k AS idx FROM (SELECT k, r, unnest(range(k)) AS d FROM (SELECT count(*) AS k, unnest(range(2000)) AS r FROM c))), s AS (SELECT r, sum(total) / sum(n) AS v FROM d JOIN c USING (idx) GROUP BY 1)
      SELECT round(quantile_cont(v, 0.025), 9) AS ci_low, round(quantile_cont(v, 0.975), 9) AS ci_high FROM s"""
    q["judge_noise"] = f"WITH {_VERDICT} SELECT source, round(avg(abs(quality - toxic) / 2.0::DOUBLE), 9) AS noise FROM vd GROUP BY 1"
    q["parse_markers"] = f"""WITH x AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda s: {_strip('s')}) AS l FROM documents), y AS (SELECT doc_id, l, len(l) AS n, doc_id % 5 <> 0 AND len(list_filter(l, lambda s: s = '')) = 0 AS ok FROM x)
      SELECT doc_id, n::BIGINT AS n, ok, CASE WHEN ok THEN sha1(array_to_string(l, '|')) END AS parts_sha1 FROM y"""
    q["parse_score"] = "SELECT doc_id, CASE WHEN doc_id % 8 - 1 BETWEEN 1 AND 5 THEN (doc_id % 8 - 1)::INTEGER END AS score, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS verdict FROM documents"
    q["run_tiling"] = f"WITH {_RUNS} SELECT book_key, run, slot::INTEGER AS slot, position FROM ru"
    q["lead_in_antijoin"] = f"""WITH {_RUNS}, j AS (SELECT DISTINCT segment_hash FROM ru), f AS (SELECT book_key, chapter_index, run FROM ru WHERE slot = 0),
      c AS (SELECT f.book_key, f.run, b.back, s.id, (s.chapter_index = f.chapter_index AND s.t <> '' AND s.position % 13 <> 5 AND s.segment_hash NOT IN (SELECT segment_hash FROM j)) AS good FROM f CROSS JOIN (VALUES (1), (2)) b(back) JOIN seg s ON s.book_key = f.book_key AND s.position = f.run - b.back)
      SELECT book_key, run, back, id FROM (SELECT *, min(good::INTEGER) OVER (PARTITION BY book_key, run ORDER BY back) AS g FROM c) WHERE g = 1"""
    q["paired_delta"] = f"""WITH {_VERDICT}, c AS (SELECT lang, source, sum(toxic - quality)::DOUBLE AS total, count(*) AS n FROM vd GROUP BY 1, 2), i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS k FROM c),
      d AS (SELECT lang, r, {_number("sha1('42:' || r || ':' || d)")} % k AS idx FROM (SELECT lang, k, r, unnest(range(k)) AS d FROM (SELECT lang, k, unnest(range(2000)) AS r FROM (SELECT DISTINCT lang, k FROM i)))),
      s AS (SELECT d.lang, r, sum(total) / sum(n) AS v FROM d JOIN i ON d.lang = i.lang AND d.idx = i.idx GROUP BY 1, 2), ci AS (SELECT lang, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM s GROUP BY 1),
      m AS (SELECT lang, count(*) AS n, count(DISTINCT source) AS n_clusters, avg(quality) AS control_mean, avg(toxic) AS variant_mean, avg(toxic - quality) AS delta FROM vd GROUP BY 1)
      SELECT lang, n, n_clusters, round(control_mean, 9) AS control_mean, round(variant_mean, 9) AS variant_mean, round(delta, 9) AS delta, round(lo, 9) AS ci_low, round(hi, 9) AS ci_high, CASE WHEN lo > 0 THEN 'win' WHEN hi < 0 THEN 'regression' ELSE 'inconclusive' END AS verdict, n_clusters < 5 AS low_power FROM m JOIN ci USING (lang)"""
    q["strata_features"] = f"SELECT doc_id, line_no::INTEGER AS line_no, {_words('text')}::INTEGER AS words, CASE WHEN {_words('text')} >= 80 THEN 'long' WHEN {_words('text')} >= 35 THEN 'medium' ELSE 'short' END AS band, array_to_string({_STRATA_LIST}, ',') AS strata FROM ({_LINES})"
    q["band_quota"] = f"""WITH RECURSIVE {_ELIGIBLE}, c AS (SELECT book_slug, band, count(*) AS n FROM cb GROUP BY 1, 2),
      r(book_slug, band, n, p, k) AS (SELECT book_slug, band, n, greatest(1, round_even(12 * n::DOUBLE / sum(n) OVER (PARTITION BY book_slug), 0))::BIGINT, 0 FROM c UNION ALL
        SELECT book_slug, band, n, p + CASE WHEN can AND nth <= abs(miss) THEN sign(miss)::BIGINT ELSE 0 END, k + 1 FROM (
          SELECT *, row_number() OVER (PARTITION BY book_slug, can ORDER BY n DESC, CASE band WHEN 'short' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS nth, bool_or(can) OVER (PARTITION BY book_slug) AS any_can
          FROM (SELECT *, CASE WHEN miss < 0 THEN p > 1 ELSE p < n END AS can FROM (SELECT *, (12 - sum(p) OVER (PARTITION BY book_slug))::BIGINT AS miss FROM r))) WHERE miss <> 0 AND any_can AND k < 50)
      SELECT book_slug, band, n, arg_max(p, k)::INTEGER AS quota FROM r GROUP BY 1, 2, 3"""
    names = ", ".join(f"('{s}')" for s in text.STRATA)
    q["manifest_coverage"] = f"""WITH {_ELIGIBLE}, ch AS (SELECT *, {_STRATA_LIST} AS strata FROM cb QUALIFY row_number() OVER (PARTITION BY book_slug ORDER BY sha1('42:' || id)) <= 5), s AS (SELECT name, count(*) AS n FROM (SELECT unnest(strata) AS name FROM ch) GROUP BY 1)
      SELECT 'stratum' AS kind, v.name, coalesce(n, 0) AS n, coalesce(n, 0) >= 6 AS met FROM (VALUES {names}) v(name) LEFT JOIN s ON s.name = v.name UNION ALL SELECT 'band', band, count(*), true FROM ch GROUP BY 2 UNION ALL SELECT 'book', book_slug, count(*), true FROM ch GROUP BY 2"""
    q["manifest_verify"] = f"WITH {_ELIGIBLE} SELECT book_slug, chapter_index, CASE WHEN position % 70 = 0 THEN position + 1000000 ELSE position END AS position, CASE WHEN position % 70 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM cb WHERE position % 10 = 0 AND (position % 70 = 0 OR position % 30 = 0)"
    q["lww_merge"] = f"WITH {_LOG} SELECT user_id, event_type, arrival, updated_at, value FROM lg QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY updated_at DESC, arrival DESC) = 1"
    q["delete_wins"] = f"""WITH RECURSIVE {_LOG}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY arrival) AS k FROM lg),
      f AS (SELECT user_id, event_type, k, value, updated_at, (op = 'delete') AS deleted, 1::BIGINT AS n_applied, 0::BIGINT AS n_conflicts FROM o WHERE k = 1 UNION ALL
        SELECT f.user_id, f.event_type, o.k, CASE WHEN a THEN o.value ELSE f.value END, CASE WHEN a THEN o.updated_at ELSE f.updated_at END, CASE WHEN a THEN o.op = 'delete' ELSE f.deleted END, n_applied + a::INTEGER, n_conflicts + (NOT a)::INTEGER
        FROM f JOIN o ON o.user_id = f.user_id AND o.event_type = f.event_type AND o.k = f.k + 1 CROSS JOIN LATERAL (SELECT o.updated_at >= f.updated_at AND NOT (f.deleted AND o.op = 'upsert') AS a) ap)
      SELECT user_id, event_type, value, updated_at, deleted, n_applied, n_conflicts FROM f QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY k DESC) = 1"""
    q["conflicts"] = f"""WITH {_LOG}, c AS (SELECT user_id, event_type, max(updated_at) AS current_at FROM lg WHERE arrival % 2 = 0 GROUP BY 1, 2)
      SELECT arrival, CASE WHEN current_at > updated_at THEN 'conflict' ELSE 'applied' END AS status, CASE WHEN current_at > updated_at THEN current_at END AS current_at FROM lg LEFT JOIN c USING (user_id, event_type) WHERE arrival % 2 = 1"""
    q["keyset_page"] = f"""WITH {_LOG}, m AS (SELECT min(updated_at) + 100 AS t FROM lg), p AS (SELECT updated_at, arrival, user_id FROM lg, m WHERE updated_at > t OR (updated_at = t AND arrival > 0) ORDER BY updated_at, arrival LIMIT 101)
      SELECT *, row_number() OVER (ORDER BY updated_at, arrival) > 100 AS more FROM p"""
    q["keyset_page_descending"] = f"WITH {_LOG}, p AS (SELECT updated_at, arrival, user_id FROM lg ORDER BY updated_at DESC, arrival DESC LIMIT 51) SELECT *, row_number() OVER (ORDER BY updated_at DESC, arrival DESC) > 50 AS more FROM p"
    q["public_shelves"] = f"WITH {_PUBLIC} SELECT o_orderkey, o_custkey, o_totalprice FROM pub"
    q["public_feed"] = f"WITH {_PUBLIC}, p AS (SELECT o_orderkey, floor(epoch(o_orderdate))::BIGINT AS created_at FROM pub ORDER BY 2 DESC, 1 DESC LIMIT 101) SELECT *, row_number() OVER (ORDER BY created_at DESC, o_orderkey DESC) > 100 AS more FROM p"
    q["fk_orphans"] = "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 97 <> 3)"
    q["constraint_violations"] = """SELECT "check", count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM (SELECT l_orderkey, 'percent' AS "check" FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 0.08 UNION ALL SELECT l_orderkey, 'kind' FROM lineitem WHERE l_returnflag NOT IN ('A', 'R') UNION ALL SELECT l_orderkey, 'stars' FROM lineitem WHERE l_quantity > 45) GROUP BY 1"""
    q["catalog_disambiguate"] = f"""WITH b AS (SELECT '/books/p' || page_id || '.epub' AS path, 'p' || page_id AS stem, regexp_extract(url, '^[a-z]+://(?:www[.]|m[.]|blog[.])?([^/]+)', 1) AS title, regexp_extract(url, '/([a-z]{{2}})/', 1) AS lang, length(html) * 700 AS size FROM pages),
      c AS (SELECT *, count(*) OVER (PARTITION BY lower(title), lower(lang)) > 1 AS twice, title || CASE WHEN lang <> '' AND NOT regexp_matches(lower(title), '{EDGE[0]}' || lang || '{EDGE[1]}') THEN ' (' || lang || ')' ELSE '' END AS name FROM b)
      SELECT substr(sha256(path), 1, 16) AS id, title, lang AS author_line, CASE WHEN size >= 1000000 THEN replace(format('{{:.1f}} MB', size / 1000000), '.', ',') ELSE greatest(1, round_even(size / 1000, 0)::BIGINT) || ' kB' END AS size,
        name || CASE WHEN twice THEN ' — ' || stem ELSE '' END || '.epub' AS download_name, CASE WHEN twice THEN stem END AS distinguisher FROM c"""
    safe = lambda x: f"regexp_replace({x}, '{_UNSAFE}', '', 'g')"
    undotted = rf"regexp_replace(regexp_replace({_strip(safe('title'))}, '^\.+', ''), '\.+\z', '')"
    q["download_names"] = rf"""WITH x AS (SELECT p_partkey, p_type, CASE p_partkey % 3 WHEN 0 THEN ' ' || p_name || '/' || p_brand || ': [sl]  part.' WHEN 1 THEN p_name ELSE '?' END AS title FROM part),
      y AS (SELECT *, {_collapse(undotted)} AS s, {_strip(safe('p_type'))} AS f FROM x),
      z AS (SELECT *, CASE WHEN s <> '' THEN s WHEN f <> '' THEN f ELSE 'book' END AS stem FROM y)
      SELECT p_partkey, {_strip(f"substr(CASE WHEN NOT regexp_matches(lower(stem), '{EDGE[0]}sl{EDGE[1]}') THEN stem || ' (sl)' ELSE stem END, 1, 100)")} || '.epub' AS name, CASE WHEN p_partkey % 100 = 1 THEN 'knjiga' WHEN p_partkey % 100 = 2 THEN 'knjigi' WHEN p_partkey % 100 IN (3, 4) THEN 'knjige' ELSE 'knjig' END AS noun FROM z"""
    rows = ", ".join(f"('{t}', {'NULL' if p is None else repr(p)}, '{s}')" for t, p, s in styles.STYLES)
    q["style_resolution"] = f"""WITH st(tier, lang, style) AS (VALUES {rows}), d AS (SELECT doc_id, lang AS "primary", CASE WHEN doc_id % 3 = 0 THEN 'economy' ELSE 'quality' END AS tier FROM documents)
      SELECT doc_id, "primary", coalesce(a.style, b.style) AS style FROM d LEFT JOIN st a ON a.tier = d.tier AND a.lang = d."primary" JOIN st b ON b.tier = d.tier AND b.lang IS NULL"""
    q["clean_titles"] = rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(string_split(text, chr(10))[1], '[ .]+', '_', 'g'), '_', ' '), '[{WS}]+', ' ', 'g'), '^[ -]+', ''), '[ -]+\z', '') AS title FROM documents"""
    q["glossary_identity"] = f"""WITH x AS (SELECT conv_id, regexp_extract(text, '^([A-Za-z]+)', 1) AS t, regexp_extract(text, '([A-Za-z]+)[^A-Za-z]*$', 1) AS r FROM conversations), y AS (SELECT conv_id, t, min(r) AS r FROM x WHERE t <> '' GROUP BY 1, 2)
      SELECT conv_id, count(*) AS n_terms, sha1({_strip("string_agg('- ' || t || ' -> ' || r, chr(10) ORDER BY t)")}) AS glossary_hash FROM y GROUP BY 1"""
    q["excerpt_prefix"] = f"""WITH {_SEG}, x AS (SELECT book_key, position, t, sum(length(t)) OVER (PARTITION BY book_key ORDER BY position) - length(t) AS before FROM seg WHERE t <> ''), e AS (SELECT book_key, substr(string_agg(t, chr(10) || chr(10) ORDER BY position), 1, 6000) AS e FROM x WHERE before < 6000 GROUP BY 1)
      SELECT book_key, length(e)::BIGINT AS n_chars, sha1(e) AS excerpt_sha1 FROM e"""
    q["requests_per_minute"] = "SELECT user_id, max(n) AS most, count(*) FILTER (n > 60) AS n_limited FROM (SELECT user_id, date_trunc('minute', ts) AS w, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1"
    q["memo_replace"] = "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"
    q["migrated_translations"] = """WITH t AS (SELECT conv_id, arg_max(role, turn) AS terms FROM conversations WHERE turn % 2 = 1 GROUP BY 1)
      SELECT c.conv_id::VARCHAR AS book_hash, 'baseline_v1' AS prompt_version, sha1(coalesce(terms, '')) AS glossary_hash, count(*) AS n FROM conversations c LEFT JOIN t USING (conv_id) GROUP BY 1, 2, 3"""
    q["escaped_lines"] = "SELECT page_id, sha1(replace(replace(html, '&', '&amp;'), '<', '&lt;')) AS escaped_sha1, len(regexp_extract_all(lower(html), '<(em|strong|i|b)>'))::BIGINT AS n_emphasis FROM pages"
    q["prompt_digests"] = r"""SELECT doc_id, substr(sha1(encode(lang) || '\x00'::BLOB || encode(CASE WHEN doc_id % 3 > 0 THEN source ELSE '' END) || '\x00'::BLOB || encode(text)), 1, 16) AS digest, sha1(text) AS block_hash FROM documents"""
    q["epub_round_trip"] = f"""WITH {_SEG} SELECT book_key, chapter_index, position, type, heading_level, id, sha1({_strip('chapter_title')}) AS title_sha1, sha1(t) AS text_sha1 FROM seg2 WHERE t <> ''"""
    q["epub_metadata"] = """SELECT DISTINCT source AS book_key, '"' || source || '" & <more>' AS title, source || '|A & B' AS authors, 'sl' AS language, 'ok' AS status FROM documents"""
    shown = f"""{_SEG}, im AS (SELECT DISTINCT book_key, chapter_index, doc_id FROM seg WHERE chapter_index % 5 = 2)"""
    q["epub_images"] = f"""WITH {shown} SELECT book_key, 'img' || lpad((row_number() OVER (PARTITION BY book_key ORDER BY chapter_index))::VARCHAR, 4, '0') AS image_id, 'image/png' AS media_type, chapter_index, NULL::VARCHAR AS anchor_id, '<' || doc_id || '">' AS alt, sha1('png' || doc_id) AS data_sha1 FROM im"""
    q["book_json_round_trip"] = f"""WITH {shown} SELECT s.book_key, s.chapter_index, position, type, heading_level, id, sha1(text) AS text_sha1, CASE WHEN im.doc_id IS NOT NULL THEN sha1('png' || im.doc_id) END AS data_sha1 FROM seg2 s LEFT JOIN im USING (book_key, chapter_index)"""
    q["sync_push"] = """WITH i AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_discount > 0.08 THEN 'discount' WHEN l_orderkey % 97 = 3 THEN 'missing_parent' END AS error FROM lineitem),
      a AS (SELECT 'shelf_items' AS entity, CASE WHEN error IS NULL THEN 'applied' ELSE 'error' END AS status, error, id FROM i UNION ALL SELECT 'shelves', CASE WHEN o_orderkey % 5 = 0 THEN 'conflict' ELSE 'applied' END, NULL, o_orderkey FROM orders)
      SELECT entity, status, error, count(*) AS n, sum(id)::BIGINT AS ids FROM a GROUP BY 1, 2, 3"""
    q["owner_pull"] = f"""WITH {_LOG}, p AS (SELECT user_id, updated_at, arrival FROM lg WHERE user_id = (SELECT min(user_id) FROM lg) AND (updated_at > 0 OR arrival > 0) ORDER BY updated_at, arrival LIMIT 26) SELECT *, row_number() OVER (ORDER BY updated_at, arrival) > 25 AS more FROM p"""
    head = "'Translate into: sl.' || chr(10) || chr(10) || 'STYLE MEMO of the book, for every segment:' || chr(10) || 'Plain words.' || chr(10) || chr(10) || 'TERMS, always with these renderings:' || chr(10) || '- and -> in'"
    q["translation_accounts"] = f"""WITH ln AS (SELECT doc_id, line_no, text, {_strip('text')} AS t FROM ({_LINES})),
      br AS (SELECT *, CASE WHEN t <> '' AND coalesce(lag(t) OVER (PARTITION BY doc_id ORDER BY line_no), '') <> '' THEN 0 ELSE 1 END AS brk FROM ln), isl AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM br),
      sl AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, island ORDER BY line_no) - 1) // 20 AS part FROM isl WHERE t <> ''), nu AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island, part ORDER BY line_no) AS n FROM sl),
      ca AS (SELECT length({head}) + sum(2 + length('[[' || n || ']] ' || text)) AS asked, sum(length('[[' || n || ']] <12345678> ' || t)) + count(*) - 1 AS got FROM nu GROUP BY doc_id, island, part),
      tk AS (SELECT count(*) AS n_calls, sum(asked // 4)::BIGINT AS input_tokens, sum(got // 4)::BIGINT AS output_tokens FROM ca), sg AS (SELECT count(*) AS n_segments, sum(CASE WHEN t = '' THEN length(text) ELSE 11 + length(t) END)::BIGINT AS n_chars FROM ln)
      SELECT 'gpt-5-mini' AS model, 'batch' AS kind, n_calls, input_tokens, output_tokens, round({_COST}, 6) AS cost_eur, n_segments, n_chars FROM tk, sg"""
    return q
