"""The corpus queries that SQL can express, for DuckDB."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op2_decontamination": f"""
        WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
        items AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
        cuts AS (SELECT item, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS pos FROM items WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item, size, array_to_string(w[pos:pos + size - 1], ' ') AS words FROM cuts),
        sizes AS (SELECT DISTINCT size FROM windows),
        places AS (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM docs, sizes WHERE len(w) >= size),
        found AS (SELECT rid, item, p.size, pos FROM (SELECT *, array_to_string(w[pos:pos + size - 1], ' ') AS words FROM places) p
                  JOIN windows USING (size, words)),
        hits AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + size)) AS place FROM found) GROUP BY rid),
        named AS (SELECT rid, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items
                  FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN hits USING (rid) LEFT JOIN named USING (rid)""",
    "op7_near_duplicates": f"""
        WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        named AS (SELECT doc_id, w, array_to_string(w, ' ') AS content FROM docs),
        texts AS (SELECT row_number() OVER () AS t, content, any_value(w) AS w, count(*) AS copies, min(doc_id) AS least
                  FROM named WHERE len(w) > 0 GROUP BY content),
        shingles AS (SELECT t, unnest(list_distinct(CASE WHEN len(w) < 5 THEN [content]
                       ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM texts),
        sizes AS (SELECT t, count(*) AS n FROM shingles GROUP BY t),
        shared AS (SELECT a.t AS a, b.t AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.t <> b.t GROUP BY 1, 2),
        links AS (SELECT a, b FROM shared JOIN sizes x ON x.t = a JOIN sizes y ON y.t = b WHERE 10 * shared.n >= 8 * (x.n + y.n - shared.n)),
        reach AS (SELECT t, t AS other FROM texts UNION SELECT reach.t, links.b FROM reach JOIN links ON links.a = reach.other),
        classes AS (SELECT reach.t, min(o.least) AS class_id, sum(o.copies) AS class_size FROM reach JOIN texts o ON o.t = reach.other GROUP BY reach.t),
        linked AS (SELECT a AS t, sum(copies) AS n FROM links JOIN texts ON texts.t = b GROUP BY a)
        SELECT doc_id, CASE WHEN texts.t IS NULL THEN doc_id ELSE class_id END AS class_id,
               (coalesce(linked.n, 0) + coalesce(copies - 1, 0))::BIGINT AS n_links, coalesce(class_size, 1)::BIGINT AS class_size
        FROM named LEFT JOIN texts ON texts.content = named.content AND len(named.w) > 0
          LEFT JOIN classes USING (t) LEFT JOIN linked ON linked.t = texts.t""",
    "op9_chat": """
        WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
        marked AS (SELECT *, CASE WHEN role IS NULL THEN 'n' ELSE 'r' || role END || chr(1) || CASE WHEN text IS NULL THEN 'n' ELSE 't' || text END AS mark
                   FROM turns),
        logs AS (SELECT conv_id, list(mark ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS marks FROM marked GROUP BY conv_id),
        once AS (SELECT min(conv_id) AS conv_id, marks FROM logs GROUP BY marks),
        earlier AS (SELECT DISTINCT marks[1:n] AS marks FROM (SELECT marks, unnest(range(1, len(marks))) AS n FROM logs)),
        kept AS (SELECT conv_id FROM once ANTI JOIN earlier USING (marks)),
        lines AS (SELECT conv_id, turn, role, text, coalesce(floor(turn / 1024), -1)::BIGINT AS part,
                         '<|im_start|>' || replace(replace(coalesce(role, 'unknown'), '<|im_start|>', '|im_start|>'), '<|im_end|>', '|im_end|>') || chr(10) || replace(replace(coalesce(text, ''), '<|im_start|>', '|im_start|>'), '<|im_end|>', '|im_end|>') || '<|im_end|>' || chr(10) AS line
                  FROM turns SEMI JOIN kept ON turns.conv_id IS NOT DISTINCT FROM kept.conv_id)
        SELECT conv_id, part, count(*) AS n_turns, string_agg(line, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text
        FROM lines GROUP BY conv_id, part""",
    "op13_spelling": """
        WITH RECURSIVE runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
        per_doc AS (SELECT id, run, count(*) AS n FROM runs GROUP BY id, run),
        crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
        bytes AS (SELECT run, n, steps, flatten(list_transform(string_split(id || ':' || run, ''),
                lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)) AS b FROM per_doc, crc),
        summed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes),
        slipped AS (SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM summed),
        words AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        cuts AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
        less AS (SELECT word, i, word[:i - 1] AS a, word[i + 1:] AS b FROM cuts),
        near AS (SELECT x.word, y.word AS other FROM less x JOIN less y USING (i, a, b) WHERE x.word <> y.word
                 UNION SELECT less.word, words.word FROM less JOIN words ON words.word = a || b
                 UNION SELECT words.word, less.word FROM less JOIN words ON words.word = a || b),
        ranked AS (SELECT near.word, other, n AS m, count(*) OVER (PARTITION BY near.word) AS n_near,
                   row_number() OVER (PARTITION BY near.word ORDER BY n DESC, other) AS place FROM near JOIN words ON words.word = other),
        forms AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n
                  FROM words LEFT JOIN ranked ON ranked.word = words.word AND place = 1),
        chains AS (SELECT word, word AS root FROM words UNION ALL SELECT chains.word, form FROM chains JOIN forms ON forms.word = root WHERE form IS NOT NULL),
        ends AS (SELECT chains.word, root FROM chains JOIN forms ON forms.word = root WHERE form IS NULL)
        SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)""",
    "op12_phrases": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        sized AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS size FROM worded),
        grams AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
                  FROM sized WHERE len(w) >= size),
        counts AS (SELECT lang, size, phrase, count(*) AS n FROM grams GROUP BY ALL),
        totals AS (SELECT lang, sum(n)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
        cands AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND n >= 30),
        lengths AS (SELECT *, unnest(range(2, size)) AS length FROM cands WHERE size > 2),
        inner_spans AS (SELECT lang, a, w, length, unnest(range(1, size - length + 2)) AS i FROM lengths),
        longer AS (SELECT lang, array_to_string(w[i:i + length - 1], ' ') AS phrase, max(a) AS most FROM inner_spans GROUP BY ALL),
        stay AS (SELECT cands.* FROM cands LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most::HUGEINT < 80 * a::HUGEINT),
        cut AS (SELECT *, unnest(range(1, size)) AS k FROM stay),
        scored AS (SELECT cut.lang, cut.phrase, a, k, x.n AS l, y.n AS r, (2000000 * a::HUGEINT // (x.n + y.n)::HUGEINT)::BIGINT AS score FROM cut
                   JOIN counts x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1:k], ' ')
                   JOIN counts y ON y.lang = cut.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, rank, phrase, a, l, r, n, score FROM
          (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest) JOIN totals USING (lang)
        WHERE rank <= 2000""",
}
