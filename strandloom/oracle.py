"""The same queries in DuckDB's SQL, written from the definitions and not from the Spark plans."""

from __future__ import annotations

K, M, M_HEAVY = 31, 13, 5

_HEX = "'0123456789abcdef', 'ACGTACGTACGTACGT'"


def _md5(tags: str, col: str) -> str:
    return " || ".join(f"translate(md5('{t}' || cast({col} AS VARCHAR)), {_HEX})" for t in tags)


PART = f"part_seq AS (SELECT p_partkey AS id, {_md5('abcd', 'p_partkey')} AS seq FROM part)"
DOCS = "doc_seq AS (SELECT doc_id AS id, regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', '', 'g') AS seq FROM documents)"
READS = f"""{PART}, cuts AS (SELECT id, seq, substr(seq, 1 + id % 60, 60) AS sl, lead(seq) OVER (ORDER BY id) AS nxt FROM part_seq),
reads AS (SELECT id AS query_id, CASE WHEN id % 10 = 0 THEN substr(sl, 1, 30) || 'N' || substr(sl, 32) WHEN id % 5 = 0 THEN substr(sl, 1, 5) || 'N' || substr(sl, 7)
  WHEN id % 7 = 0 THEN {_md5('zy', 'id')} WHEN id % 11 = 0 THEN substr(sl, 1, 20) WHEN id % 13 = 0 THEN lower(sl)
  WHEN id % 17 = 0 AND nxt IS NOT NULL THEN right(seq, 30) || left(nxt, 30)
  WHEN id % 2 = 1 THEN reverse(translate(sl, 'ACGT', 'TGCA')) ELSE sl END AS seq FROM cuts)"""


def _rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def _windows(source: str, name: str, k: int = K, ident: str = "id") -> str:
    return f"""{name} AS (SELECT {ident}, pos, substr(seq, pos + 1, {k}) AS kmer FROM
 (SELECT {ident}, seq, cast(unnest(range(0, length(seq) - {k} + 1)) AS INTEGER) AS pos FROM {source} WHERE length(seq) >= {k}))"""


def _bits(x: str, k: str | int) -> str:
    return f"cast(list_sum(list_transform(range(0, {k}), lambda j: cast(strpos('ACTG', substr({x}, cast(j AS INTEGER) + 1, 1)) - 1 AS BIGINT) << (2 * j))) AS BIGINT)"


def _mix(v: str) -> str:
    return f"(xor({v}, 1431655765) % 2147483647 * 48271 % 2147483647)"


def _strings(source: str, k: int = K) -> str:
    return f"""strings AS (SELECT cast(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS string_id,
 cast(sum(length(seq)) OVER (ORDER BY id) - length(seq) AS BIGINT) AS string_begin, cast(sum(length(seq)) OVER (ORDER BY id) AS BIGINT) AS string_end, seq, id
 FROM {source} WHERE length(seq) >= {k})"""


def _stored(k: int = K) -> str:
    return f"""stored AS (SELECT string_begin + pos AS kmer_offset, string_id, string_begin, string_end, substr(seq, pos + 1, {k}) AS kmer FROM
 (SELECT *, cast(unnest(range(0, length(seq) - {k} + 1)) AS INTEGER) AS pos FROM strings)),
firsts AS (SELECT kmer, min(kmer_offset) AS kmer_offset, arg_min(string_id, kmer_offset) AS string_id, arg_min(string_begin, kmer_offset) AS string_begin,
 arg_min(string_end, kmer_offset) AS string_end FROM stored GROUP BY kmer)"""


def _lookup(source: str, k: int = K, canonical: bool = False) -> str:
    """hits: the source's rows with both strands' first places, and which one is taken."""
    fwd = "f.kmer_offset IS NOT NULL" + (" AND (r.kmer_offset IS NULL OR f.kmer_offset <= r.kmer_offset)" if canonical else "")
    pick = lambda c: f"CASE WHEN {fwd} THEN f.{c} ELSE r.{c} END"
    return f"""hits AS (SELECT q.*, {pick('kmer_offset')} AS off, {pick('string_id')} AS sid, {pick('string_begin')} AS sb, {pick('string_end')} AS se,
 CASE WHEN {fwd} THEN 1 WHEN r.kmer_offset IS NOT NULL THEN -1 END AS ori
 FROM {source} q LEFT JOIN firsts f ON f.kmer = upper(q.kmer) LEFT JOIN firsts r ON r.kmer = {_rc('upper(q.kmer)')})"""


FULL = f"off IS NOT NULL AS found, off - sid * {K - 1} AS kmer_id, off - sb AS kmer_id_in_string, off AS kmer_offset, cast(ori AS INTEGER) AS orientation, sid AS string_id, sb AS string_begin, se AS string_end"
PART_DICT = f"{READS}, {_strings('part_seq')}, {_stored()}, {_windows('reads', 'w', ident='query_id')}, {_lookup('w')}"
DOCS_DICT = f"{DOCS}, {_strings('doc_seq')}, {_stored()}, {_windows('doc_seq', 'w')}"


def _mins(source: str, m: int, canonical: bool = False, cols: str = "id") -> str:
    """mins: minimizer value v and its place i for every window p of the source."""
    base = f"""mers AS (SELECT {cols}, i, {_bits(f'substr(seq, i + 1, {m})', m)} AS v, {_bits(_rc(f'substr(seq, i + 1, {m})'), m)} AS rv FROM
 (SELECT {cols}, seq, cast(unnest(range(0, length(seq) - {m} + 1)) AS INTEGER) AS i FROM {source} WHERE length(seq) >= {K})),
spread AS (SELECT {cols}, unnest(range(greatest(0, i - {K - m}), i + 1)) AS p, i, v, rv FROM mers),
lens AS (SELECT {cols.split(',')[0]} AS lid, length(seq) - {K} AS last FROM {source} WHERE length(seq) >= {K}),
near AS (SELECT s.* FROM spread s JOIN lens ON lid = {cols.split(',')[0]} WHERE p <= last),
fwd AS (SELECT {cols}, p, arg_min({{'v': v, 'i': i}}, {_mix('v')} * 1000000 + i) AS f, arg_min({{'v': rv, 'i': i}}, {_mix('rv')} * 1000000 + 999999 - i) AS r FROM near GROUP BY {cols}, p)"""
    if canonical:
        return base + f", mins AS (SELECT {cols}, p, CASE WHEN r.v < f.v THEN r.v ELSE f.v END AS v, CASE WHEN r.v < f.v THEN r.i ELSE f.i END AS i FROM fwd)"
    return base + f", mins AS (SELECT {cols}, p, f.v AS v, f.i AS i FROM fwd)"


def _tuples(m: int, canonical: bool = False) -> str:
    return f"""{PART}, {_strings('part_seq')}, {_mins('strings', m, canonical, 'string_id, string_begin')},
marked AS (SELECT *, CASE WHEN lag(v) OVER o = v AND lag(i) OVER o = i THEN 0 ELSE 1 END AS new FROM mins WINDOW o AS (PARTITION BY string_id ORDER BY p)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY string_id ORDER BY p) AS run FROM marked),
tuples AS (SELECT string_id, cast(min(p) AS INTEGER) AS first_pos, any_value(v) AS minimizer, any_value(string_begin + i) AS pos_in_seq,
 cast(any_value(i) - min(p) AS INTEGER) AS pos_in_kmer, cast(count(*) AS INTEGER) AS num_kmers FROM runs GROUP BY string_id, run)"""


TUPLE_COLS = "string_id, first_pos, minimizer, pos_in_seq, pos_in_kmer, num_kmers"


def _buckets(m: int = M_HEAVY) -> str:
    return _tuples(m) + """, buckets AS (SELECT minimizer, count(DISTINCT pos_in_seq) AS bucket_size, count(*) AS num_tuples, cast(sum(num_kmers) AS BIGINT) AS num_kmers,
 CASE WHEN count(DISTINCT pos_in_seq) = 1 THEN 'singleton' WHEN count(DISTINCT pos_in_seq) <= 64 THEN 'light' ELSE 'heavy' END AS bucket_class FROM tuples GROUP BY minimizer)"""


_CLASSES = ("singleton", "light", "heavy")
STATS = ", ".join(
    [
        "count(*) AS num_buckets", "cast(sum(num_kmers) AS BIGINT) AS num_kmers", "cast(sum(bucket_size) AS BIGINT) AS num_positions", "max(bucket_size) AS max_bucket_size",
        *[f"count(*) FILTER (bucket_class = '{c}') AS num_{c}_buckets" for c in _CLASSES],
        *[f"cast(coalesce(sum(num_kmers) FILTER (bucket_class = '{c}'), 0) AS BIGINT) AS num_kmers_in_{c}" for c in _CLASSES],
        "cast(coalesce(sum(num_tuples) FILTER (bucket_class <> 'singleton'), 0) AS BIGINT) AS num_super_kmers_in_non_singleton",
    ]
)
TOTALS = f"""totals AS (SELECT (SELECT count(*) FROM strings) AS num_strings, (SELECT cast(sum(length(seq)) AS BIGINT) FROM strings) AS total_bases,
 (SELECT cast(sum(length(seq) - {K - 1}) AS BIGINT) FROM strings) AS num_kmers, (SELECT count(DISTINCT minimizer) FROM tuples) AS num_minimizers)"""
POSITIONS = """positions AS (SELECT DISTINCT unnest(range(string_begin, string_end + 1)) AS pos FROM strings)"""
ASKED = f"{_windows('reads', 'w', ident='query_id')}, asked AS (SELECT query_id, kmer FROM w UNION ALL SELECT query_id, seq FROM reads WHERE length(seq) < {K})"
TWO = f"""{PART}, two_set AS (SELECT id, {_rc(f"(left(seq, 64) || {_md5('zy', 'id')})")} AS seq FROM part_seq), {_windows('part_seq', 'w1')}, {_windows('two_set', 'w2')}"""


def _canonical(source: str) -> str:
    """The lesser of a k-mer and its reverse complement in the order of 2-bit codes, last base first."""
    key = lambda x: f"reverse(translate({x}, 'ACTG', '0123'))"
    return f"SELECT DISTINCT CASE WHEN {key('kmer')} < {key(_rc('kmer'))} THEN kmer ELSE {_rc('kmer')} END AS kmer FROM {source}"


SCAN = f"""{PART_DICT}, flags AS (SELECT *, coalesce(regexp_matches(kmer, '^[ACGTacgt]*$'), false) AS valid,
 coalesce(off IS NOT NULL AND lag(sid) OVER o = sid AND lag(ori) OVER o = ori AND off = lag(off) OVER o + ori, false) AS ext FROM hits WINDOW o AS (PARTITION BY query_id ORDER BY pos))"""
# A scan that stays on its string: all places of all windows, the stretches of each diagonal, and a walk from search to search.
FOLLOWED = f"""{DOCS}, {_strings('doc_seq')}, {_stored()}, asked AS (SELECT id, seq FROM doc_seq UNION ALL SELECT -1 - id, {_rc('seq')} FROM doc_seq), {_windows('asked', 'w')}, {_lookup('w')},
same AS (SELECT w.id, w.pos, string_id, 1 AS ori, kmer_offset - w.pos AS diagonal FROM w JOIN stored USING (kmer) UNION ALL SELECT w.id, w.pos, string_id, -1, kmer_offset + w.pos FROM w JOIN stored ON stored.kmer = {_rc('w.kmer')}),
islands AS (SELECT *, pos - row_number() OVER (PARTITION BY id, string_id, ori, diagonal ORDER BY pos) AS island FROM same),
ends AS (SELECT id, string_id, ori, diagonal, min(pos) AS lo, max(pos) AS hi FROM islands GROUP BY id, string_id, ori, diagonal, island),
reach AS (SELECT h.id, h.pos, h.off, h.ori, h.sid, e.hi FROM hits h JOIN ends e ON e.id = h.id AND e.string_id = h.sid AND e.ori = h.ori AND e.diagonal = h.off - h.ori * h.pos AND h.pos BETWEEN e.lo AND e.hi),
later AS (SELECT id, pos, min(CASE WHEN off IS NOT NULL THEN pos END) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM hits),
ahead AS (SELECT r.id, r.pos, later.nxt FROM reach r JOIN later ON later.id = r.id AND later.pos = r.hi + 1),
walk(id, pos) AS (SELECT id, min(pos) FROM reach GROUP BY id UNION ALL SELECT walk.id, ahead.nxt FROM walk JOIN ahead ON ahead.id = walk.id AND ahead.pos = walk.pos WHERE ahead.nxt IS NOT NULL),
runs AS (SELECT reach.* FROM walk JOIN reach USING (id, pos))"""
_LOG2 = "CASE WHEN {0} <= 1 THEN 0 ELSE length(bin(cast({0} AS BIGINT) - 1)) END"


def _log2(x: str) -> str:
    return _LOG2.format(x)


ORACLE_SQL: dict[str, str] = {
    "fasta_scan": f"WITH {PART} SELECT cast(id AS VARCHAR) AS name, seq FROM part_seq",
    "fastq_scan": f"WITH {PART} SELECT cast(id AS VARCHAR) AS name, seq, repeat('@', 128) AS qual FROM part_seq",
    "plain_scan": f"WITH {PART} SELECT seq FROM part_seq",
    "kmer_list_scan": f"WITH {READS} SELECT upper(seq) AS kmer FROM reads WHERE seq <> ''",
    "cfseg_scan": f"WITH {PART} SELECT id * 10 AS segment_id, seq FROM part_seq",
    "cfseg_errors": f"""WITH {PART}, lines AS (SELECT id % 1000 + 1 AS line, id, CASE WHEN id % 11 = 0 THEN id::VARCHAR WHEN id % 7 = 0 THEN 's' || id || ' ' || seq WHEN id % 5 = 0 THEN id || chr(9) || 'ACGTNACGT' WHEN id % 3 = 0 THEN '' ELSE NULL END AS text FROM part_seq)
SELECT line, CASE WHEN id % 11 = 0 THEN 'no sequence' WHEN id % 7 = 0 THEN 'no segment number' ELSE 'letters other than ACGT' END AS reason, text FROM lines WHERE text <> ''""",
    "record_callback": f"""WITH {DOCS}, runs AS (SELECT id, max(length(r)) AS longest FROM (SELECT id, unnest(regexp_extract_all(seq, 'A+|C+|G+|T+')) AS r FROM doc_seq) GROUP BY id)
SELECT d.id, cast(length(replace(replace(seq, 'A', ''), 'T', '')) AS BIGINT) AS gc, coalesce(longest, 0) AS longest_run FROM doc_seq d LEFT JOIN runs ON runs.id = d.id WHERE seq IS NOT NULL""",
    "kmers_sql": f"WITH {DOCS}, {_windows('doc_seq', 'w')} SELECT * FROM w",
    "super_kmers_sql": f"WITH {_tuples(M)} SELECT s.id, first_pos, minimizer, pos_in_kmer, num_kmers FROM tuples JOIN strings s USING (string_id)",
    "seq_counts": f"WITH {DOCS} SELECT count(*) AS sequences, cast(sum(length(seq)) AS BIGINT) AS bases FROM doc_seq",
    "dict_roundtrip": f"WITH {PART}, {_strings('part_seq')} SELECT id, cast(unnest(range(0, 128 - {K} + 1)) AS INTEGER) AS pos, string_begin - string_id * {K - 1} + pos AS kmer_id, string_begin + pos AS kmer_offset, string_id FROM strings",
    "base_encode": f"WITH {DOCS} SELECT id, translate(seq, 'ACTG', '0123') AS codes, seq AS bases FROM doc_seq",
    "revcomp": f"WITH {DOCS} SELECT id, translate(seq, 'ACGT', 'TGCA') AS comp, {_rc('seq')} AS rc FROM doc_seq",
    "pack_bytes": f"""WITH {DOCS} SELECT id, array_to_string(list_transform(range(0, cast(ceil(length(seq) / 4) AS BIGINT)), lambda b: lower(printf('%02x', cast(list_sum(list_transform(range(0, 4), lambda j:
 CASE WHEN substr(seq, cast(4 * b + j AS INTEGER) + 1, 1) = '' THEN 0 ELSE (strpos('ACTG', substr(seq, cast(4 * b + j AS INTEGER) + 1, 1)) - 1) << (2 * j) END)) AS BIGINT)))), '') AS packed_hex, seq AS unpacked FROM doc_seq""",
    "kmer_windows": f"WITH {DOCS}, {_windows('doc_seq', 'w')} SELECT * FROM w",
    "kmer_pack": f"WITH {PART}, {_windows('part_seq', 'w')} SELECT id, pos, {_bits('kmer', K)} AS bits FROM w",
    "kmer_unpack": f"WITH {PART}, {_windows('part_seq', 'w')} SELECT id, pos, kmer FROM w",
    "canonical_kmer": f"""WITH {DOCS}, {_windows('doc_seq', 'w')} SELECT id, pos, CASE WHEN reverse(translate(kmer, 'ACTG', '0123')) < translate(translate(kmer, 'ACGT', 'TGCA'), 'ACTG', '0123')
 THEN kmer ELSE {_rc('kmer')} END AS canonical FROM w""",
    "kmer_get_base": f"WITH {PART}, {_windows('part_seq', 'w')} SELECT id, pos, kmer[1] AS first, kmer[16] AS middle, kmer[31] AS last FROM w",
    "kmer_set_base": f"WITH {PART}, {_windows('part_seq', 'w')} SELECT id, pos, left(kmer, 2) || 'T' || substr(kmer, 4) AS kmer FROM w",
    "kmer_append": f"WITH {PART}, {_windows('part_seq', 'w')} SELECT id, pos, 'G' || left(kmer, {K - 1}) AS kmer FROM w",
    "dna_valid": f"WITH {READS} SELECT query_id, regexp_matches(seq, '^[ACGTacgt]*$') AS valid FROM reads",
    "query_validity": f"WITH {READS}, {ASKED} SELECT query_id, kmer, length(kmer) = {K} AS right_length, regexp_matches(kmer, '^[ACGTacgt]{{{K}}}$') AS valid FROM asked",
    "mmer_hash": f"WITH {PART}, {_windows('part_seq', 'w', M)} SELECT id, pos, {_mix(_bits('kmer', M))} AS hash FROM w",
    "bucket_log2": f"WITH {DOCS} SELECT id, cast({_log2('length(seq)')} AS INTEGER) AS log2 FROM doc_seq",
    "kmer_pack_long": f"WITH {PART}, {_windows('part_seq', 'w', 63)} SELECT id, pos, {_bits('kmer', 31)} AS l0, {_bits('substr(kmer, 32, 31)', 31)} AS l1, {_bits('substr(kmer, 63, 1)', 1)} AS l2 FROM w",
    "spss_strings": f"WITH {DOCS}, {_strings('doc_seq')} SELECT string_id, string_begin, string_end, seq FROM strings",
    "access_kmer": f"""WITH {DOCS}, {_strings('doc_seq')}, wanted AS (SELECT string_id, seq, cast(unnest(range(-1, length(seq) + 1)) AS BIGINT) AS pos FROM strings)
SELECT string_id, pos, CASE WHEN pos >= 0 AND pos + {K} <= length(seq) THEN substr(seq, pos + 1, {K}) END AS kmer FROM wanted""",
    "kmer_at_pos": f"""WITH {DOCS}, {_strings('doc_seq')}, {POSITIONS} SELECT pos, string_id, CASE WHEN pos + {K} <= string_end THEN substr(seq, pos - string_begin + 1, {K}) END AS kmer
FROM positions LEFT JOIN strings ON pos >= string_begin AND pos < string_end""",
    "locate": f"WITH {DOCS}, {_strings('doc_seq')}, {POSITIONS} SELECT pos, string_id, string_begin, string_end FROM positions LEFT JOIN strings ON pos >= string_begin AND pos < string_end",
    "no_cross_boundary": f"WITH {DOCS}, {_strings('doc_seq')} SELECT unnest(range(string_end - {K}, string_end)) AS pos, string_id, unnest(range(0, {K})) = 0 AS inside FROM strings",
    "minimizers": f"WITH {PART}, {_mins('part_seq', M)} SELECT id, cast(p AS INTEGER) AS pos, v AS minimizer, cast(i - p AS INTEGER) AS pos_in_kmer FROM mins",
    "canonical_minimizers": f"WITH {PART}, {_mins('part_seq', M, True)} SELECT id, cast(p AS INTEGER) AS pos, v AS minimizer, cast(i - p AS INTEGER) AS pos_in_kmer FROM mins",
    "super_kmers": f"WITH {_tuples(M)} SELECT {TUPLE_COLS} FROM tuples",
    "canonical_super_kmers": f"WITH {_tuples(M, True)} SELECT {TUPLE_COLS} FROM tuples",
    "sorted_tuples": f"WITH {_tuples(M)} SELECT {TUPLE_COLS} FROM tuples ORDER BY minimizer, pos_in_seq",
    "merge_stats": f"WITH {_tuples(M_HEAVY)} SELECT count(DISTINCT minimizer) AS num_minimizers, count(DISTINCT (minimizer, pos_in_seq)) AS num_positions, count(*) AS num_super_kmers FROM tuples",
    "minimizer_counts": f"WITH {_tuples(M)} SELECT minimizer, count(*) AS num_super_kmers, cast(sum(num_kmers) AS BIGINT) AS num_kmers FROM tuples GROUP BY minimizer",
    "buckets": f"WITH {_buckets()} SELECT * FROM buckets",
    "bucket_class_hist": f"WITH {_buckets()} SELECT bucket_class, count(*) AS num_buckets, cast(sum(bucket_size) AS BIGINT) AS num_positions, cast(sum(num_kmers) AS BIGINT) AS num_kmers FROM buckets GROUP BY bucket_class",
    "bucket_stats": f"WITH {_buckets()} SELECT {STATS} FROM buckets",
    "bucket_stats_pct": f"WITH {_buckets()}, s AS (SELECT {STATS} FROM buckets) SELECT "
    + ", ".join([f"round(num_{c}_buckets * 100.0 / num_buckets, 6)::DOUBLE AS pct_{c}_buckets" for c in _CLASSES] + [f"round(num_kmers_in_{c} * 100.0 / num_kmers, 6)::DOUBLE AS pct_kmers_in_{c}" for c in _CLASSES])
    + " FROM s",
    "bucket_ranges": f"""WITH {_buckets()} SELECT cast(row_number() OVER o - 1 AS BIGINT) AS bucket_id, minimizer, cast(sum(bucket_size) OVER o - bucket_size AS BIGINT) AS "begin", cast(sum(bucket_size) OVER o AS BIGINT) AS "end"
FROM buckets WINDOW o AS (ORDER BY minimizer)""",
    "heavy_buckets_topk": f"WITH {_buckets()} SELECT minimizer, bucket_size FROM buckets WHERE bucket_class = 'heavy' ORDER BY bucket_size DESC, minimizer LIMIT 10",
    "skew_partitions": f"""WITH {_buckets()} SELECT cast(greatest(0, least({_log2('bucket_size')} - 7, 7)) AS INTEGER) AS skew_partition, count(*) AS num_buckets, cast(sum(num_kmers) AS BIGINT) AS num_kmers, max(bucket_size) AS max_bucket_size
FROM buckets WHERE bucket_class = 'heavy' GROUP BY 1""",
    "lookup_full": f"WITH {PART_DICT} SELECT query_id, pos, kmer, {FULL} FROM hits",
    "lookup_offset": f"WITH {DOCS_DICT}, {_lookup('w')} SELECT id, pos, off AS kmer_offset FROM hits",
    "lookup_chunked": f"WITH {PART_DICT} SELECT query_id, pos, off - sid * {K - 1} AS kmer_id, off AS kmer_offset, cast(ori AS INTEGER) AS orientation, sid AS string_id FROM hits",
    "lookup_orientation": f"WITH {PART_DICT} SELECT query_id, pos, off AS kmer_offset, cast(ori AS INTEGER) AS orientation FROM hits",
    "lookup_canonical": f"WITH {DOCS_DICT}, {_lookup('w', canonical=True)} SELECT id, pos, kmer, {FULL} FROM hits",
    "lookup_long": f"""WITH {PART}, {_strings('part_seq', 63)}, {_stored(63)}, turned AS (SELECT id, CASE WHEN id % 2 = 0 THEN {_rc('seq')} ELSE seq END AS seq FROM part_seq), {_windows('turned', 'w', 63)}, {_lookup('w', 63)}
SELECT id, pos, off - sid * 62 AS kmer_id, off AS kmer_offset, cast(ori AS INTEGER) AS orientation, sid AS string_id FROM hits""",
    "membership_semi": f"WITH {PART_DICT} SELECT query_id, pos, kmer FROM hits WHERE off IS NOT NULL",
    "membership_anti": f"WITH {PART_DICT} SELECT query_id, pos, kmer FROM hits WHERE off IS NULL",
    "membership_sketched": f"WITH {PART}, {DOCS}, {_strings('part_seq')}, {_stored()}, {_windows('doc_seq', 'w')} SELECT id, pos, kmer FROM w WHERE kmer NOT IN (SELECT kmer FROM stored) AND {_rc('kmer')} NOT IN (SELECT kmer FROM stored)",
    "minimizer_join": f"WITH {READS}, {_strings('part_seq')}, {_stored()}, {_windows('reads', 'w', ident='query_id')} SELECT query_id, pos, f.kmer_offset FROM w JOIN firsts f ON f.kmer = upper(w.kmer)",
    "minimizer_join_canonical": f"""WITH {DOCS}, {_strings('doc_seq')}, {_stored()}, asked AS (SELECT id AS query_id, seq FROM doc_seq UNION ALL SELECT -1 - id, {_rc('seq')} FROM doc_seq), {_windows('asked', 'w', ident='query_id')}, {_lookup('w', canonical=True)}
SELECT query_id, pos, off AS kmer_offset, cast(ori AS INTEGER) AS orientation FROM hits WHERE off IS NOT NULL""",
    "minimizer_found": f"""WITH {READS}, {_strings('part_seq')}, whole AS (SELECT query_id, regexp_replace(upper(seq), '[^ACGT]', 'A', 'g') AS seq FROM reads), {_mins('whole', M, cols='query_id')},
mine AS (SELECT query_id, p, v, i FROM mins JOIN reads USING (query_id) WHERE regexp_matches(substr(reads.seq, cast(p AS INTEGER) + 1, {K}), '^[ACGTacgt]*$')), {_mins('strings', M, cols='string_id').replace('mers AS', 'mers2 AS').replace('FROM mers)', 'FROM mers2)').replace('spread AS', 'spread2 AS').replace('spread s', 'spread2 s').replace('lens AS', 'lens2 AS').replace('JOIN lens', 'JOIN lens2').replace('near AS', 'near2 AS').replace('FROM near', 'FROM near2').replace('fwd AS', 'fwd2 AS').replace('FROM fwd', 'FROM fwd2').replace('mins AS', 'mins2 AS')},
known AS (SELECT DISTINCT v AS kv FROM mins2)
SELECT query_id, cast(p AS INTEGER) AS pos, v AS minimizer, cast(i - p AS INTEGER) AS pos_in_kmer, kv IS NOT NULL AS minimizer_found FROM mine LEFT JOIN known ON kv = v""",
    "kmer_union": f"WITH {TWO} {_canonical('w1')} UNION {_canonical('w2')}",
    "kmer_intersect": f"WITH {TWO} {_canonical('w1')} INTERSECT {_canonical('w2')}",
    "kmer_except": f"WITH {TWO} {_canonical('w1')} EXCEPT {_canonical('w2')}",
    "segment_lookup": f"WITH {DOCS}, {_strings('doc_seq')} SELECT id * 10 + 3 AS segment_id, string_id FROM strings",
    "stream_lookup": f"WITH {SCAN} SELECT query_id, pos, valid, off IS NOT NULL AS found, off AS kmer_offset, cast(ori AS INTEGER) AS orientation, ext AS is_extension FROM flags",
    "stream_stats": f"""WITH {SCAN} SELECT count(*) AS windows, count(off) AS found, count(*) - count(off) AS not_found, round(count(off) * 100.0 / count(*), 6)::DOUBLE AS hit_rate,
 count(*) FILTER (off IS NOT NULL AND NOT ext) AS searches, count(*) FILTER (ext) AS extensions, count(*) FILTER (NOT valid) AS invalid, count(*) FILTER (valid AND off IS NULL) AS negative FROM flags""",
    "stream_runs_docs": f"WITH RECURSIVE {FOLLOWED} SELECT id AS query_id, cast(pos AS BIGINT) AS first_pos, cast(hi - pos + 1 AS BIGINT) AS num_kmers, off AS kmer_offset, cast(ori AS BIGINT) AS orientation, sid AS string_id FROM runs",
    "stream_stats_docs": f"""WITH RECURSIVE {FOLLOWED} SELECT count(*) AS windows, count(off) AS found, count(*) - count(off) AS not_found, round(count(off) * 100.0 / count(*), 6)::DOUBLE AS hit_rate,
 (SELECT count(*) FROM runs) AS searches, (SELECT cast(coalesce(sum(hi - pos), 0) AS BIGINT) FROM runs) AS extensions, 0::BIGINT AS invalid, count(*) FILTER (off IS NULL) AS negative FROM hits""",
    "spss_violations": f"""WITH {DOCS}, {_strings('doc_seq')}, {_stored()}, {_canonical('stored').replace('SELECT DISTINCT', 'turned AS (SELECT kmer_offset,')})
SELECT kmer, count(*) AS places, min(kmer_offset) AS first_offset, max(kmer_offset) AS last_offset FROM turned GROUP BY kmer HAVING count(*) > 1""",
    "stream_check": f"""WITH {PART_DICT}, ways AS (SELECT DISTINCT kmer, upper(kmer) AS same, {_rc('upper(kmer)')} AS turned FROM w),
direct AS (SELECT ways.kmer, coalesce(min(stored.kmer_offset) FILTER (stored.kmer = same), min(stored.kmer_offset) FILTER (stored.kmer = turned)) AS place FROM ways JOIN stored ON stored.kmer IN (same, turned) GROUP BY ways.kmer)
SELECT count(*) AS windows, count(*) FILTER (off IS DISTINCT FROM place) AS mismatches FROM hits LEFT JOIN direct ON direct.kmer = hits.kmer""",
    "stream_static": f"""WITH {PART_DICT}, per AS (SELECT query_id AS rid, count(*) AS windows, count(off) AS found, min(off) AS first_offset FROM hits GROUP BY query_id)
SELECT event_id AS query_id, windows, found, first_offset FROM events JOIN per ON rid = event_id % (SELECT count(*) FROM part) + 1""",
    "stream_chunked": f"""WITH {SCAN}, per AS (SELECT query_id AS rid, count(*) AS windows, count(off) AS found, count(*) FILTER (off IS NOT NULL AND NOT ext) AS searches, count(*) FILTER (ext) AS extensions, count(*) FILTER (NOT valid) AS invalid FROM flags GROUP BY query_id)
SELECT event_id AS query_id, windows, found, searches, extensions, invalid FROM events JOIN per ON rid = event_id % (SELECT count(*) FROM part) + 1""",
    "query_report": f"""WITH {READS}, {_strings('part_seq')}, {_stored()}, {ASKED}, {_lookup('asked')}
SELECT count(off) AS found, count(*) - count(off) AS not_found, count(*) AS total, round(count(off) * 100.0 / count(*), 6)::DOUBLE AS hit_rate FROM hits""",
    "self_check": f"WITH {DOCS_DICT}, {_lookup('w')} SELECT kmer FROM hits WHERE off IS NULL ORDER BY kmer LIMIT 10",
    "self_check_totals": f"WITH {DOCS_DICT}, {_lookup('w')} SELECT count(*) AS windows, count(*) FILTER (off IS NULL) AS missing FROM hits",
    "dict_stats": f"WITH {_tuples(M)}, {TOTALS} SELECT num_strings, total_bases, num_kmers, num_minimizers, {K} AS k, {M} AS m, false AS canonical FROM totals",
    "string_lengths": f"WITH {DOCS}, {_strings('doc_seq')} SELECT cast(length(seq) AS BIGINT) AS string_length, count(*) AS num_strings FROM strings GROUP BY 1",
    "space_model": f"""WITH {_buckets()}, {TOTALS}, s AS (SELECT {STATS} FROM buckets),
parts AS (SELECT t.num_kmers, 2 * total_bases AS strings_bits, num_strings * (2 + {_log2('(total_bases // num_strings)')}) AS string_offsets_bits, num_positions * {_log2('total_bases')} AS offsets_bits,
 4 * num_minimizers AS mphf_bits, 4 * num_kmers_in_heavy AS skew_mphf_bits FROM totals t, s)
SELECT *, strings_bits + string_offsets_bits + offsets_bits + mphf_bits + skew_mphf_bits AS total_bits,
 round((strings_bits + string_offsets_bits + offsets_bits + mphf_bits + skew_mphf_bits) / num_kmers, 6)::DOUBLE AS bits_per_kmer FROM parts""",
    "build_estimate": f"WITH {_tuples(M)}, {TOTALS} SELECT num_kmers, num_kmers * 48 AS estimated_bytes, num_kmers * 48 > 8589934592 AS needs_external_sort FROM totals",
}
