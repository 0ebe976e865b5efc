"""DuckDB twins of the queries that SQL can express."""

ALPHANUMERIC = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op1_substring_dedup": f"""
        WITH docs AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
        windows AS (
            SELECT doc_id, i, array_to_string(words[i : i + 34], ' ') AS win
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM docs WHERE len(words) >= 35)),
        repeated AS (SELECT win FROM windows GROUP BY win HAVING count(*) > 1),
        covered AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS spot FROM windows JOIN repeated USING (win)),
        gone AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
        spots AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS spot FROM docs),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY spot) AS text
            FROM spots ANTI JOIN covered USING (doc_id, spot) GROUP BY doc_id)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(gone.n, 0) AS n_removed,
            sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM docs LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op3_sharding": """
        WITH docs AS (
            SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes,
                lpad(bin(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)), 60, '0') AS bits
            FROM documents),
        levels AS (SELECT *, substr(bits, 1, level) AS name FROM docs, range(33) r(level)),
        sums AS (
            SELECT level, name, CAST(sum(bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs
            FROM levels GROUP BY level, name HAVING sum(bytes) <= 262144 OR count(*) = 1)
        SELECT doc_id, name, CAST(level AS INTEGER) AS depth, bytes, shard_bytes, shard_docs
        FROM levels JOIN sums USING (level, name)
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY level) = 1
    """,
    "op4_chat_formatting": """
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL
            SELECT -1, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok'
            FROM range(2) r(t)),
        sized AS (
            SELECT *, CASE
                WHEN contains(text, '<|im_end|>') OR contains(text, '<|im_start|>') OR contains(text, '<||>')
                THEN length(replace(text, '<|', '<||>')) ELSE length(text) END
                + length(role) + 12 + 1 + 11 AS chars
            FROM rows)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(chars)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id
    """,
    "op7_decontamination": f"""
        WITH items AS (
            SELECT DISTINCT CAST(item_id AS VARCHAR) AS item,
                regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{ALPHANUMERIC}') AS words
            FROM benchmark),
        windows AS (
            SELECT DISTINCT item, size, array_to_string(words[i : i + size - 1], ' ') AS win
            FROM (SELECT item, words, least(13, len(words)) AS size,
                    unnest(range(1, len(words) - least(13, len(words)) + 2)) AS i
                FROM items WHERE len(words) > 0)),
        sizes AS (SELECT DISTINCT size FROM windows),
        docs AS (
            SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{ALPHANUMERIC}') AS words
            FROM documents),
        places AS (
            SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i
            FROM docs, sizes WHERE len(words) >= size),
        hits AS (
            SELECT doc_id, i, p.size, item
            FROM places p JOIN windows w
            ON p.size = w.size AND array_to_string(words[i : i + p.size - 1], ' ') = w.win),
        covered AS (
            SELECT doc_id, count(DISTINCT spot) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + size)) AS spot FROM hits) GROUP BY doc_id),
        met AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
            coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
        FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN met USING (doc_id)
    """,
    "op12_fill_in_middle": r"""
        WITH docs AS (
            SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h,
                regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
            FROM documents),
        drawn AS (
            SELECT doc_id, t, units, len(units) AS n,
                CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS one,
                CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS two,
                CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50
                    THEN 'plain' WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
            FROM docs),
        cut AS (
            SELECT *, coalesce(array_to_string(units[1 : least(one, two)], ''), '') AS p,
                coalesce(array_to_string(units[least(one, two) + 1 : greatest(one, two)], ''), '') AS m,
                coalesce(array_to_string(units[greatest(one, two) + 1 :], ''), '') AS s
            FROM drawn)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form,
            CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
            CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
            sha256(t) AS restored_sha256
        FROM cut
    """,
    "op11_spelling_variants": f"""
        WITH RECURSIVE crc_table AS (
            SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
                lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS steps
            FROM range(256) r(n)),
        runs AS (
            SELECT doc_id, run, count(*) AS times FROM (
                SELECT doc_id, unnest(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[a-z\u00C0-\u00FF]+')) AS run
                FROM documents) WHERE length(run) >= 7 GROUP BY doc_id, run),
        coded AS (SELECT run, times, hex(encode(doc_id || ':' || run)) AS code FROM runs),
        hashed AS (
            SELECT run, times, xor(4294967295, list_reduce(
                [4294967295] || list_transform(range(1, length(code), 2), lambda i: CAST('0x' || substr(code, i, 2) AS BIGINT)),
                lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) AS h
            FROM coded, crc_table),
        slipped AS (
            SELECT times, CASE WHEN h % 31 = 0
                THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
            FROM hashed),
        words AS (
            SELECT word, CAST(sum(times) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
        gaps AS (
            SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest
            FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)),
        near AS (
            SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.rest = w.word
            UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.rest = w.word),
        best AS (
            SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, other_n FROM near
            QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) = 1),
        formed AS (
            SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form,
                CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
            FROM words LEFT JOIN best USING (word)),
        paths AS (
            SELECT word, form AS stop FROM formed WHERE form IS NOT NULL
            UNION ALL SELECT paths.word, formed.form FROM paths JOIN formed ON paths.stop = formed.word WHERE formed.form IS NOT NULL),
        final AS (SELECT paths.word, stop AS root FROM paths JOIN formed ON stop = formed.word WHERE formed.form IS NULL)
        SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM formed LEFT JOIN final USING (word)
    """,
}
