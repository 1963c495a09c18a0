"""DuckDB SQL for the queries that SQL can express."""



def product_codes(rounds: int = 6) -> str:
    """Plain Lloyd rounds over all parts and entries, one after another."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT rid, p, min(d * 16 + k) AS m FROM
            (SELECT rid, p, k, CAST(list_sum(list_transform(list_zip(s.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
             FROM s JOIN c{r} c USING (p)) GROUP BY rid, p)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT p, k, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN
            (SELECT p, k, list(CAST((t - ((t % n + n) % n)) // n AS BIGINT) ORDER BY j) AS v FROM
             (SELECT s.p, a.m % 16 AS k, j, sum(s.v[j]) AS t, count(*) AS n FROM s JOIN a{r} a USING (rid, p), range(1, len(s.v) + 1) g(j)
              GROUP BY s.p, a.m % 16, j) GROUP BY p, k) n USING (p, k))""")
    return f"""
        WITH q AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label,
                 list_transform(embedding, lambda v: CAST(floor(4096 * CAST(v AS DOUBLE)) AS BIGINT)) AS x
             FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
             s AS MATERIALIZED (SELECT rid, p, x[p * len(x) // 8 + 1:(p + 1) * len(x) // 8] AS v FROM q, range(8) g(p)),
             c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, v
                 FROM s JOIN (SELECT rid, vec_id FROM q ORDER BY vec_id LIMIT 16) USING (rid)),
             {", ".join(steps)},
             f AS (SELECT rid, string_agg(printf('%02x', m % 16), '' ORDER BY p) AS code, CAST(sum(m // 16) AS BIGINT) AS error FROM a{rounds} GROUP BY rid),
             h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM q JOIN f USING (rid), h"""


def _crc32(hexed: str) -> str:
    """The checksum of hexadecimal text, bit by bit of each byte: the remainder of a byte is the sum of its bits' remainders."""
    of_bit = []
    for bit in range(8):
        c = 1 << bit
        for _ in range(8):
            c = c >> 1 ^ (c & 1) * 0xEDB88320  # the polynomial
        of_bit.append(c)
    low = "c >> 8"
    for bit, rest in enumerate(of_bit):
        low = f"xor({low}, ((xor(c, v) >> {bit}) & 1) * {rest})"
    values = f"list_transform(regexp_extract_all({hexed}, '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce({values}, lambda c, v: {low}, 4294967295), 4294967295)"


SQL = {
    "op3_jump_sharding": f"""
        WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, CAST(strlen(x) + 1 AS BIGINT) AS size, {_crc32("hex(encode(x))")} AS text_crc32
                 FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)),
             j AS (SELECT id, n, CAST(CAST('0x' || md5(id)[1:16] AS UBIGINT) AS HUGEINT) AS key, -1::DOUBLE AS here, 0::DOUBLE AS next
                   FROM (SELECT DISTINCT coalesce(CAST(doc_id AS VARCHAR), 'null') AS id FROM documents), range(8, 10) s(n)
                   UNION ALL
                   SELECT id, n, key, next, floor((next + 1) * (2147483648::DOUBLE / (CAST(key // 8589934592 AS DOUBLE) + 1)))
                   FROM (SELECT id, n, next, (key * 2862933555777941757 + 1) % 18446744073709551616 AS key FROM j WHERE next < n)),
             p AS (SELECT id, CAST(max(CASE n WHEN 8 THEN here END) AS INTEGER) AS shard, CAST(max(CASE n WHEN 9 THEN here END) AS INTEGER) AS grown_shard FROM j GROUP BY id)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY
                   CAST('0x' || md5(concat(id, ':', text_crc32, ':', size))[1:15] AS BIGINT), doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
        FROM t JOIN p ON id = coalesce(CAST(doc_id AS VARCHAR), 'null')""",
    "op13_hamerly_codes": product_codes(),
    "op1_cover_substrings": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
             one AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
             win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
             hit AS (SELECT doc_id, i FROM win JOIN (SELECT h, min(doc_id) AS f FROM win GROUP BY h) USING (h) WHERE f < doc_id),
             gone AS (SELECT DISTINCT doc_id, i + o AS p FROM hit, range(50) r(o)),
             kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM one ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op8_warc_index": """
        WITH t AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM t)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    "op9_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY x)""",
    "op11_buffer_fim": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                          sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS g FROM documents),
             h AS (SELECT doc_id, x, u, len(u) AS n, CAST('0x' || g[1:8] AS BIGINT) AS h1, CAST('0x' || g[9:16] AS BIGINT) AS h2,
                          CAST('0x' || g[17:24] AS BIGINT) AS h3, CAST('0x' || g[25:32] AS BIGINT) AS h4 FROM t),
             c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
             p AS (SELECT doc_id, x, n, array_to_string(u[:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf,
                          CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                               WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                      ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(x) AS restored_sha256
        FROM p""",
}
