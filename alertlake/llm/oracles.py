"""SQL for the queries that SQL can express."""

from __future__ import annotations


def op1_minhash_dedup() -> str:
    """Exact similarity of all pairs that share a shingle, and the smallest id that can be reached over links."""
    return r"""WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    shingles AS (
        SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM words, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) >= 5
        UNION SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 4),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
    SELECT a AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, a = component_id AS kept FROM least LEFT JOIN sizes ON doc_id = a"""


def op2_warc_audit() -> str:
    """Compare every record of both replicas, without trees."""

    def replica(source: str) -> str:
        head = "'WARC/1.0' || crlf || 'WARC-Type: response' || crlf || 'WARC-Target-URI: ' || coalesce(url, '') || crlf || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '')"
        tail = "'>' || crlf || 'Content-Type: application/http; msgtype=response' || crlf || 'Content-Length: ' || CAST(strlen(body) AS VARCHAR) || crlf || crlf || body || crlf || crlf"
        return f"""SELECT warc_file, page_id, digest, CAST(strlen(record) AS BIGINT) AS length,
            CAST(coalesce(sum(strlen(record)) OVER (PARTITION BY warc_file ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
        FROM (SELECT *, sha256(record) AS digest FROM (SELECT *, {head} || {tail} AS record FROM (
            SELECT page_id, url, CAST(floor(page_id / 512) AS BIGINT) AS warc_file, chr(13) || chr(10) AS crlf,
                'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS body FROM {source})))"""

    damaged = """(SELECT page_id, url, CASE WHEN page_id % 211 = 3 THEN substring(html, 1, length(html) - 7)
        WHEN page_id % 101 = 7 THEN '#' || substring(html, 2) ELSE html END AS html FROM pages WHERE page_id % 307 <> 11)"""
    return f"""WITH l AS ({replica("pages")}), r AS ({replica(damaged)})
    SELECT coalesce(l.warc_file, r.warc_file) AS warc_file, coalesce(l.page_id, r.page_id) AS page_id,
        l."offset" AS offset_left, l.length AS length_left, l.digest AS digest_left, r."offset" AS offset_right, r.length AS length_right, r.digest AS digest_right,
        CASE WHEN l.digest IS NULL THEN 'added' WHEN r.digest IS NULL THEN 'missing' WHEN l.length <> r.length THEN 'resized' ELSE 'altered' END AS fault
    FROM l FULL JOIN r ON l.page_id = r.page_id WHERE l.digest IS DISTINCT FROM r.digest"""


def op4_embedding_dedup() -> str:
    """All pairs, and the smallest id that can be reached over links."""
    return """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
    counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT a AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, a = component_id AS kept FROM least LEFT JOIN counts USING (a)"""


def op8_suffix_dedup() -> str:
    """Every 50-byte string (100 hexadecimal digits) with its smallest document; covered bytes as merged spans."""
    return """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
    windows AS (SELECT doc_id, p, md5_number(x[2 * p + 1:2 * p + 100]) AS s FROM h, unnest(range(0, len(x) // 2 - 49)) AS t(p)),
    firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)),
    hits AS (SELECT doc_id, p FROM windows JOIN firsts USING (s) WHERE first < doc_id),
    steps AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50, TRUE) AS new FROM hits),
    groups AS (SELECT doc_id, p, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM steps),
    spans AS (SELECT doc_id, min(p) AS low, max(p) + 50 AS high FROM groups GROUP BY doc_id, g),
    gaps AS (SELECT doc_id, high AS a, lead(low) OVER (PARTITION BY doc_id ORDER BY low) AS b, low, row_number() OVER (PARTITION BY doc_id ORDER BY low) AS k FROM spans),
    kept AS (SELECT h.doc_id, max(CASE WHEN k = 1 THEN x[1:2 * low] END) || string_agg(x[2 * a + 1:2 * coalesce(b, len(x) // 2)], '' ORDER BY a) AS y FROM gaps JOIN h USING (doc_id) GROUP BY h.doc_id),
    sums AS (SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
    SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
        sha256(unhex(coalesce(y, x))) AS kept_sha256
    FROM h LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def op12_importance_resampling() -> str:
    """Every run of words with its crc32, folded byte by byte over the usual table of remainders."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    grams = "unnest(range(1, 4)) AS k(size), unnest(range(1, greatest(len(w) - size + 2, 1))) AS t(i)"
    return f"""WITH RECURSIVE remainders AS (
        SELECT list(list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, b::BIGINT) ORDER BY b) AS step FROM range(256) AS r(b)),
    d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
    source AS (SELECT r, array_to_string(w[i:i + size - 1], ' ') AS f, count(*) AS n FROM d, {grams} GROUP BY ALL),
    aim AS (SELECT array_to_string(w[i:i + size - 1], ' ') AS f, count(*) AS n FROM (SELECT {words} AS w FROM benchmark), {grams} GROUP BY ALL),
    spelt AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM source UNION SELECT f FROM aim)),
    coded AS (SELECT f, xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket FROM spelt, remainders),
    s AS (SELECT bucket, sum(n) AS s FROM source JOIN coded USING (f) GROUP BY bucket),
    t AS (SELECT bucket, sum(n) AS t FROM aim JOIN coded USING (f) GROUP BY bucket),
    totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS s_all, (SELECT coalesce(sum(t), 0) FROM t) AS t_all),
    gain AS (SELECT bucket, floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (s_all + 10000) AS DOUBLE) / CAST((coalesce(s, 0) + 1) * (t_all + 10000) AS DOUBLE))) AS g FROM s FULL JOIN t USING (bucket), totals),
    weights AS (SELECT r, sum(n) AS n_features, sum(n * g) AS weight FROM source JOIN coded USING (f) JOIN gain USING (bucket) GROUP BY r),
    scores AS (SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || CAST(doc_id AS VARCHAR))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296))) AS score FROM d LEFT JOIN weights USING (r)),
    drawn AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scores WHERE n_words >= 20 AND score IS NOT NULL)
    SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank
    FROM scores LEFT JOIN drawn USING (r)"""


def all_oracles() -> dict[str, str]:
    named = [op1_minhash_dedup, op2_warc_audit, op4_embedding_dedup, op8_suffix_dedup, op12_importance_resampling]
    return {oracle.__name__: oracle() for oracle in named}
