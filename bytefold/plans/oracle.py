"""The same queries as SQL for DuckDB."""

from __future__ import annotations

from ..functions.pretokenize import re2_pattern
from ..functions.unicode_classes import KINDS, char_class
from ..operators.prune import SPECIALS
from .queries import MIN_EXPOSURE, N_MERGES, N_WHOLE, VISIBLE

T0 = 0x10000


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pieces(source: str, key: str) -> str:
    """CTEs ending in ``pieces(key, g, chunk)``: RE2 matches, equal single neighbours joined."""
    return f"""found AS (SELECT {key} AS key, regexp_extract_all(text, {quoted(re2_pattern())}) AS l FROM {source} WHERE text <> ''),
single AS (SELECT key, unnest(l) AS c, unnest(range(len(l))) AS k FROM found),
marked AS (SELECT *, CASE WHEN length(c) = 1 AND c = lag(c) OVER w THEN 0 ELSE 1 END AS new FROM single WINDOW w AS (PARTITION BY key ORDER BY k)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY k) AS g FROM marked),
pieces AS (SELECT key, g, string_agg(c, '' ORDER BY k) AS chunk FROM numbered GROUP BY ALL)"""


def as_tokens(text: str) -> str:
    """String with one supplementary code point a byte."""
    return f"array_to_string(list_transform(range(1, octet_length(encode({text}))::BIGINT + 1), lambda i: chr(({T0} + ('0x' || substr(hex(encode({text})), (2 * i - 1)::BIGINT, 2))::INT)::INT)), '')"


UNIQUE = "u AS (SELECT chunk, count(*) AS freq, min({'o': item_ord, 'p': pos}) AS first FROM corpus_chunk WHERE chunk <> '' GROUP BY chunk)"


def train(base: str, n: int) -> str:
    """CTEs t0..tn(t, freq, first) and b1..bn(n, pair) of n merges."""
    out = [f"t0 AS MATERIALIZED ({base})"]
    for k in range(1, n + 1):
        out.append(f"""b{k} AS MATERIALIZED (SELECT substring(t, i, 2) AS pair, sum(freq)::BIGINT AS n, min({{'f': first, 'i': i}}) AS place FROM (SELECT t, freq, first, unnest(range(1, length(t))) AS i FROM t{k - 1} WHERE length(t) > 1) GROUP BY 1 ORDER BY n DESC, place LIMIT 1)""")
        out.append(f"t{k} AS MATERIALIZED (SELECT replace(t, (SELECT pair FROM b{k}), chr({T0 + 255 + k})) AS t, freq, first FROM t{k - 1})")
    return ",\n".join(out)


def merges(n: int) -> str:
    rows = " UNION ALL ".join(f"SELECT {255 + k} AS token_id, unicode(substring(pair, 1, 1)) - {T0} AS left_id, unicode(substring(pair, 2, 1)) - {T0} AS right_id, n FROM b{k} WHERE n >= 2" for k in range(1, n + 1))
    return f"m AS MATERIALIZED ({rows})"


CHUNKS = f"SELECT {as_tokens('chunk')} AS t, freq, first FROM u"
BASE = f"WITH {UNIQUE},\n{train(CHUNKS, N_MERGES)},\n{merges(N_MERGES)}"


def bytes_cte(n: int) -> str:
    """x0..xn: token_id, hex of its bytes."""
    out = ["x0 AS MATERIALIZED (SELECT i::INT AS token_id, printf('%02X', i) AS h FROM range(256) r(i))"]
    for k in range(1, n + 1):
        out.append(f"x{k} AS MATERIALIZED (SELECT * FROM x{k - 1} UNION ALL SELECT m.token_id, a.h || b.h FROM m JOIN x{k - 1} a ON a.token_id = left_id JOIN x{k - 1} b ON b.token_id = right_id WHERE m.token_id = {255 + k})")
    return ",\n".join(out)


EXPOSURE = f"e AS MATERIALIZED (SELECT unicode(c) - {T0} AS token_id, sum(freq)::BIGINT AS exposure FROM (SELECT freq, unnest(string_split(t, '')) AS c FROM t{N_MERGES}) WHERE c <> '' GROUP BY 1)"
def ids_cte(visible: int) -> str:
    """CTE ids(old_id, exposure, status, new_id) of the tables m and e."""
    return f"""s AS (SELECT m.token_id AS old_id, coalesce(exposure, 0) AS exposure, coalesce(sum((coalesce(exposure, 0) >= {MIN_EXPOSURE})::INT) OVER (ORDER BY m.token_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM m LEFT JOIN e USING (token_id)),
st AS (SELECT old_id, exposure, CASE WHEN seen >= {visible - 256} THEN 'discarded' WHEN exposure >= {MIN_EXPOSURE} THEN 'visible' ELSE 'internal' END AS status FROM s),
ids AS MATERIALIZED (SELECT old_id, exposure, status, CASE status WHEN 'visible' THEN 255 + row_number() OVER w WHEN 'internal' THEN 255 + {len(SPECIALS)} + (SELECT count(*) FROM st WHERE status = 'visible') + row_number() OVER w END::INT AS new_id FROM st WINDOW w AS (PARTITION BY status ORDER BY old_id))"""


IDS = ids_cte(VISIBLE)
FULL = f"{BASE},\n{bytes_cte(N_MERGES)},\n{EXPOSURE},\n{IDS},\nall_ids AS (SELECT old_id, new_id FROM ids WHERE new_id IS NOT NULL UNION ALL SELECT i::INT, i::INT FROM range(256) r(i))"
LEARNED = f"SELECT i.new_id AS token_id, l.new_id AS left_id, r.new_id AS right_id, h AS bytes_hex, i.old_id AS merge_rank, status FROM ids i JOIN m ON m.token_id = i.old_id JOIN x{N_MERGES} x ON x.token_id = i.old_id JOIN all_ids l ON l.old_id = m.left_id JOIN all_ids r ON r.old_id = m.right_id WHERE i.new_id IS NOT NULL"


def encode(source: str, key: str, text: str = "text") -> str:
    """Ids of whole texts: fold of replace over distinct chunks, then the id map with internals spelled out."""
    fold = "t"
    for k in range(1, N_MERGES + 1):
        kept = f"(SELECT pair FROM b{k}, ids WHERE old_id = {255 + k} AND status <> 'discarded')"
        fold = f"replace({fold}, coalesce({kept}, 'no pair'), '{chr(T0 + 255 + k)}')"
    spelled = ["y0 AS MATERIALIZED (SELECT i::INT AS old_id, i::VARCHAR AS s FROM range(256) r(i))"]
    for k in range(1, N_MERGES + 1):
        spelled.append(f"y{k} AS MATERIALIZED (SELECT * FROM y{k - 1} UNION ALL SELECT old_id, CASE WHEN status = 'internal' THEN a.s || ',' || b.s ELSE new_id::VARCHAR END FROM ids JOIN m ON m.token_id = old_id JOIN (SELECT old_id AS ao, s FROM y{k - 1}) a ON ao = left_id JOIN (SELECT old_id AS bo, s FROM y{k - 1}) b ON bo = right_id WHERE old_id = {255 + k} AND status <> 'discarded')")
    return f"""{FULL},
{', '.join(spelled)},
{pieces(source, key)},
distinct_pieces AS (SELECT chunk, {as_tokens('chunk')} AS t FROM (SELECT DISTINCT chunk FROM pieces)),
folded AS (SELECT chunk, {fold} AS t FROM distinct_pieces),
spread AS (SELECT chunk, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS k FROM folded),
chunk_ids AS (SELECT chunk, string_agg(s, ',' ORDER BY k) AS s FROM spread JOIN y{N_MERGES} ON old_id = unicode(c) - {T0} GROUP BY chunk),
texts AS (SELECT key, string_agg(s, ',' ORDER BY g) AS s FROM pieces JOIN chunk_ids USING (chunk) GROUP BY key)"""


def visible_fill() -> str:
    """The extension rule walked over the exposures after every number of merges: begin with 4, go on until 8 are visible or 20 made."""
    first, room, cap, step = 4, 8, 20, 4
    stood = " UNION ALL ".join(f"SELECT {k} AS n, freq, unnest(string_split(t, '')) AS c FROM t{k}" for k in range(first, cap + 1))
    return f"""WITH RECURSIVE {UNIQUE},
{train(CHUNKS, cap)},
{merges(cap).replace("m AS", "m_all AS", 1)},
e_all AS MATERIALIZED (SELECT n, unicode(c) - {T0} AS token_id, sum(freq)::BIGINT AS exposure FROM ({stood}) WHERE c <> '' GROUP BY ALL),
cnt AS MATERIALIZED (SELECT k AS n, (SELECT count(*) FROM e_all WHERE n = k AND token_id >= 256 AND exposure >= {MIN_EXPOSURE}) AS c FROM range({first}, {cap + 1}) r(k)),
walk(n) AS (SELECT {first}::BIGINT UNION ALL SELECT least({cap}, walk.n + greatest({step}, ceil(1.1::DOUBLE * ({room} - c))::BIGINT)) FROM walk JOIN cnt ON cnt.n = walk.n WHERE c < {room} AND walk.n < {cap}),
fin AS MATERIALIZED (SELECT max(n) AS n FROM walk),
m AS MATERIALIZED (SELECT * FROM m_all WHERE token_id <= 255 + (SELECT n FROM fin)),
e AS MATERIALIZED (SELECT token_id, exposure FROM e_all WHERE n = (SELECT n FROM fin)),
{ids_cte(256 + room)} SELECT old_id, exposure, status, new_id FROM ids"""


SPECIAL_RX = quoted("|".join(SPECIALS))


def encode_special() -> str:
    """Texts between two specials; specials inside cut a text into parts that are encoded apart."""
    cut = f"string_split_regex(text, {SPECIAL_RX})"
    parts = f"(SELECT DISTINCT item_ord || ':' || k AS pk, p AS text FROM (SELECT item_ord, unnest({cut}) AS p, generate_subscripts({cut}, 1) AS k FROM text_item WHERE text <> ''))"
    found = f"regexp_extract_all(text, {SPECIAL_RX})"
    number = lambda name: f"(256 + (SELECT count(*) FROM ids WHERE status = 'visible') + list_position([{', '.join(map(quoted, SPECIALS))}], {name}) - 1)"
    return f"""{encode(parts, 'pk')},
inner_specials AS (SELECT item_ord, k, {number('x')}::VARCHAR AS s FROM (SELECT DISTINCT item_ord, unnest({found}) AS x, generate_subscripts({found}, 1) AS k FROM text_item WHERE text <> '')),
rows AS (SELECT string_split(key, ':')[1]::BIGINT AS item_ord, string_split(key, ':')[2]::BIGINT AS k, 0 AS side, s FROM texts UNION ALL SELECT item_ord, k, 1, s FROM inner_specials),
whole AS (SELECT item_ord, string_agg(s, ',' ORDER BY k, side) AS s FROM rows GROUP BY item_ord)
SELECT item_ord, {number("'<_SOS_>'")} || ',' || coalesce(s || ',', '') || {number("'<_EOS_>'")} AS ids FROM text_item LEFT JOIN whole USING (item_ord)"""


KIND = "CASE " + " ".join(f"WHEN regexp_full_match(c, {quoted('[' + char_class(k) + ']')}) THEN '{k}'" for k in KINDS[:-1]) + f" ELSE '{KINDS[-1]}' END"


def oracles() -> dict[str, str]:
    visible_count = "(SELECT count(*) FROM ids WHERE status = 'visible')"
    specials = " UNION ALL ".join(f"SELECT (256 + {visible_count} + {k})::INT, -1, -1, '{s.encode().hex().upper()}', -1" for k, s in enumerate(SPECIALS))
    return {
        "pretok_documents": f"WITH {pieces('documents', 'doc_id')} SELECT chunk, count(*) AS n FROM pieces GROUP BY chunk",
        "pretok_items": f"WITH src AS (SELECT row_number() OVER () AS rid, text FROM text_item), {pieces('src', 'rid')} SELECT chunk, count(*) AS n FROM pieces GROUP BY chunk",
        "chunk_stats_by_source": "SELECT source_id, count(*) AS n_chunks, count(DISTINCT chunk) AS n_distinct, sum(octet_length(encode(chunk)))::BIGINT AS n_bytes FROM corpus_chunk WHERE chunk IS NOT NULL GROUP BY source_id",
        "char_kind_histogram": f"WITH c AS (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents WHERE text <> '') GROUP BY c) SELECT {KIND} AS kind, sum(n)::BIGINT AS n FROM c GROUP BY 1",
        "unique_chunks": f"WITH {UNIQUE} SELECT chunk, freq, first.o AS first_ord, first.p AS first_pos FROM u",
        "byte_histogram": "SELECT b AS byte, count(*) AS n FROM (SELECT unnest(tokens) AS b FROM corpus_chunk WHERE chunk IS NOT NULL) GROUP BY b",
        "pair_counts_round0": "SELECT tokens[i] AS left_id, tokens[i + 1] AS right_id, count(*) AS n FROM (SELECT tokens, unnest(range(1, len(tokens))) AS i FROM corpus_chunk WHERE chunk IS NOT NULL) GROUP BY 1, 2",
        "best_pair_round0": f"WITH {UNIQUE}, {train(CHUNKS, 1)}, {merges(1)} SELECT left_id, right_id, n FROM m",
        "bpe_train_16": f"{BASE},\n{bytes_cte(N_MERGES)} SELECT m.*, h AS bytes_hex FROM m JOIN x{N_MERGES} USING (token_id)",
        "token_exposure": f"{BASE},\n{EXPOSURE} SELECT * FROM e",
        "prune_visibility": f"{BASE},\n{EXPOSURE},\n{IDS} SELECT old_id, exposure, status, new_id FROM ids",
        "vocab_export": f"{FULL} SELECT token_id, left_id, right_id, bytes_hex, merge_rank FROM ({LEARNED}) WHERE status = 'visible' UNION ALL SELECT token_id, -1, -1, h, -1 FROM x0 UNION ALL {specials}",
        "inter_vocab_export": f"{FULL} SELECT token_id, left_id, right_id, bytes_hex, merge_rank FROM ({LEARNED}) WHERE status = 'internal'",
        "decode_roundtrip": "SELECT doc_id, md5(coalesce(text, '')) AS md5_back FROM documents",
        "decode_bare_items": f"SELECT item_ord, md5(regexp_replace(coalesce(text, ''), {SPECIAL_RX}, '', 'g')) AS md5_back FROM text_item",
        "resume_16": f"{BASE} SELECT * FROM m",
        "vocab_file_roundtrip": f"{FULL} SELECT token_id, left_id, right_id, bytes_hex, merge_rank FROM ({LEARNED}) UNION ALL SELECT token_id, -1, -1, h, -1 FROM x0 UNION ALL {specials}",
        "visible_fill": visible_fill(),
        "vanilla_train_8": f"WITH u AS (SELECT text AS chunk, count(*) AS freq, min({{'o': item_ord, 'p': 0}}) AS first FROM text_item WHERE text <> '' GROUP BY text), {train(CHUNKS, N_WHOLE)}, {merges(N_WHOLE)} SELECT * FROM m",
        "load_items": r"""WITH f AS (SELECT file_id, suffix, nfc_normalize(regexp_replace(regexp_replace(content, '\r\n?', chr(10), 'g'), '^' || chr(65279), '')) AS t FROM corpus_file WHERE content IS NOT NULL),
l AS (SELECT file_id, CASE WHEN suffix = '.txt' THEN list_filter(list_transform(regexp_extract_all(t, '[^\n\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]*[\n\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]|[^\n\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]+'), lambda x: rtrim(x, chr(10))), lambda x: x <> '' AND x <> '===') ELSE [t] END AS l FROM f)
SELECT file_id, unnest(range(len(l)))::INT AS line_no, unnest(l) AS text FROM l""",
        "encode_items": f"{encode('(SELECT DISTINCT item_ord, text FROM text_item)', 'item_ord')} SELECT item_ord, coalesce(s, '') AS ids FROM text_item LEFT JOIN texts ON key = item_ord",
        "encode_special_items": encode_special(),
        "compression_by_source": f"{encode('(SELECT DISTINCT item_ord, text FROM text_item)', 'item_ord')} SELECT source_id, sum(coalesce(octet_length(encode(text)), 0))::BIGINT AS n_bytes, sum(CASE WHEN s IS NULL THEN 0 ELSE len(string_split(s, ',')) END)::BIGINT AS n_tokens FROM text_item LEFT JOIN texts ON key = item_ord GROUP BY source_id",
        "merge_count_pairs": "SELECT (left_id::BIGINT << 32) | right_id AS pair_key, left_id, right_id, sum(n)::BIGINT AS n FROM merge_count WHERE n IS NOT NULL GROUP BY left_id, right_id",
        "encode_documents": f"{encode('documents', 'doc_id')} SELECT doc_id, coalesce(s, '') AS ids FROM documents LEFT JOIN texts ON key = doc_id",
    }
