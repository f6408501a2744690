"""The same results in DuckDB's SQL, over the same tables."""

from __future__ import annotations

from . import fixed_values as fv
from .standins import HYPERLINK

IMAGE = fv.IMAGE_REL_TYPE
WS = r"'[ \t\r\n]+'"
EXT = "CASE lang WHEN 'en' THEN '.png' WHEN 'fr' THEN '.jpeg' WHEN 'de' THEN '.emf' ELSE '.gif' END"
COLLAPSED = f"regexp_replace(text, {WS}, ' ', 'g')"


def size(text: str) -> str:
    return f"CAST(octet_length(encode({text})) AS BIGINT)"


def mb(n: str) -> str:
    return f"translate(format('{{:,.1f}}', CAST({n} AS DOUBLE) / 1048576), ',.', '.,') || ' MB'"


def pct(before: str, after: str) -> str:
    return (
        f"CASE WHEN {before} = 0 THEN 0.0 "
        f"ELSE (1 - CAST({after} AS DOUBLE) / CAST({before} AS DOUBLE)) * 100 END"
    )


PARTS = f"""
parts AS (
  SELECT source AS container, doc_id AS ordinal, 'word/media/doc' || doc_id || {EXT} AS part_name,
         {EXT} AS extension, {size('text')} AS file_size, n_chars AS compress_size,
         md5(text) AS crc, {size(COLLAPSED)} AS new_size
  FROM documents
)"""

KEPT = """CASE WHEN extension = '.emf' THEN 'vetorial (mantida)'
       WHEN extension = '.gif' THEN 'extensão .gif (mantida)'
       WHEN file_size < 2000 THEN (file_size // 1024) || ' KB < 1 KB (mantida)' END"""

DECISIONS = f"""{PARTS},
classed AS (SELECT *, {KEPT} AS kept FROM parts),
decisions AS (
  SELECT container, ordinal, part_name, file_size AS old_size,
         CASE WHEN kept IS NULL THEN new_size END AS new_size,
         kept IS NULL AND new_size < file_size AS accepted,
         coalesce(kept, CASE WHEN new_size >= file_size
                  THEN 'recompressão ficou maior (original mantida)' END) AS reason
  FROM classed
),
results AS (
  SELECT container, CAST(sum(old_size) AS BIGINT) AS size_before,
         CAST(sum(CASE WHEN accepted THEN new_size ELSE old_size END) AS BIGINT) AS size_after,
         count(*) FILTER (accepted) AS processed,
         count(*) FILTER (NOT accepted AND reason IS NOT NULL) AS skipped
  FROM decisions GROUP BY container
),
outcomes AS (
  SELECT *, {pct('size_before', 'size_after')} AS reduction_pct FROM results
)"""

ALTERED = f"""
labelled AS (
  SELECT d.*, l.toxic, CASE WHEN l.quality = 0 THEN {COLLAPSED} ELSE text END AS new_text
  FROM documents d LEFT JOIN labels l USING (doc_id)
),
altered AS (
  SELECT source AS container, doc_id AS ordinal, 'word/media/doc' || doc_id || {EXT} AS part_name,
         {EXT} AS extension, md5(new_text) AS crc, {size('new_text')} AS file_size
  FROM labelled WHERE NOT coalesce(toxic = 1, false)
  UNION ALL
  SELECT 'src' || item_id, item_id, 'word/item' || item_id || '.xml', '.xml', md5(text),
         {size('text')}
  FROM benchmark
)"""

DIFF = f"""{PARTS}, {ALTERED},
diff AS (
  SELECT coalesce(b.container, a.container) AS container,
         coalesce(b.part_name, a.part_name) AS part_name,
         CASE WHEN a.part_name IS NULL THEN 'missing' WHEN b.part_name IS NULL THEN 'extra'
              WHEN b.extension NOT IN ('.png', '.jpeg')
                   AND (b.crc <> a.crc OR b.file_size <> a.file_size) THEN 'changed' END AS status,
         coalesce(b.ordinal, a.ordinal) AS ordinal
  FROM parts b FULL JOIN altered a ON b.container = a.container AND b.part_name = a.part_name
)"""

VIOLATIONS = f"""{DIFF},
media AS (
  SELECT b.container, b.n AS n_before, a.n AS n_after
  FROM (SELECT container, count(*) AS n FROM parts GROUP BY 1) b
  JOIN (SELECT container, count(*) FILTER (part_name LIKE 'word/media/%') AS n
        FROM altered GROUP BY 1) a USING (container)
),
violations AS (
  SELECT DISTINCT container, 2 AS rule_no, CAST(0 AS BIGINT) AS ordinal,
         CAST(NULL AS VARCHAR) AS subject, '{fv.BAD_MEMBERS}' AS message
  FROM diff WHERE status IN ('missing', 'extra')
  UNION ALL
  SELECT container, 3, 0, NULL, 'nº de imagens difere: ' || n_before || ' vs ' || n_after
  FROM media WHERE n_before <> n_after
)"""

REFERENCES = f"""
links AS (
  SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS container,
         'word/' || regexp_extract(url, '^https?://[^/]*/([^/]*)', 1) || '/_rels/page' || page_id
           || '.xml.rels' AS rels_path,
         list_concat([url], regexp_extract_all(html, 'href="([^"]*)"', 1)) AS links
  FROM pages
),
linked AS (
  SELECT container, rels_path, unnest(links) AS link,
         CAST(generate_subscripts(links, 1) - 1 AS INTEGER) AS pos
  FROM links
),
refs AS (
  SELECT container, rels_path, pos, 'rId' || pos AS rel_id,
         CASE WHEN regexp_matches(link, '^/[A-Z]') THEN '{HYPERLINK}' ELSE '{IMAGE}' END AS rel_type,
         CASE WHEN NOT starts_with(link, '/') OR regexp_matches(link, '^/[A-Z]') THEN link
              ELSE '../media' || link END AS target
  FROM linked
),
resolved AS (
  SELECT *, target <> '' AND NOT starts_with(target, 'http://')
            AND NOT starts_with(target, 'https://') AS internal,
         CASE WHEN starts_with(target, '/') THEN ltrim(target, '/')
         ELSE coalesce(nullif(list_reduce(
           string_split(regexp_replace(rels_path, '/[^/]*/[^/]*$', '') || '/' || target, '/'),
           lambda acc, x: CASE WHEN x IN ('', '.') THEN acc
             WHEN x <> '..' OR acc IN ('', '..') OR acc LIKE '%/..'
               THEN CASE WHEN acc = '' THEN x ELSE acc || '/' || x END
             ELSE regexp_replace(acc, '/?[^/]*$', '') END, ''), ''), '.') END AS resolved
  FROM refs
),
renames AS (
  SELECT DISTINCT container, resolved, resolved || '.jpeg' AS new_part
  FROM resolved WHERE regexp_matches(resolved, '^word/media/.*e')
),
rewritten AS (
  SELECT r.*, n.new_part,
         n.new_part IS NOT NULL AND r.internal AND r.rel_type = '{IMAGE}' AS changed,
         regexp_extract(target, '^.*/') || regexp_extract(n.new_part, '[^/]*$') AS expected
  FROM resolved r LEFT JOIN renames n USING (container, resolved)
),
rewritten2 AS (
  SELECT *, CASE WHEN changed THEN expected ELSE target END AS new_target FROM rewritten
)"""

TYPES = f"""
packed AS (
  SELECT 'pkg' || (doc_id // 4) AS container, doc_id, lang, text,
         'word/media/doc' || doc_id || {EXT} AS part_name,
         CASE WHEN lang = 'es' THEN 'jpg' ELSE ltrim({EXT}, '.') END AS type_key
  FROM documents
),
types AS (
  SELECT DISTINCT container, 'default' AS kind, type_key AS key, 'image/' || type_key AS content_type
  FROM packed
  UNION ALL
  SELECT container, 'override', '/' || part_name, 'text/' || lang
  FROM packed JOIN labels USING (doc_id)
),
extensions AS (
  SELECT container, CASE WHEN bool_or(kind = 'default' AND key = 'jpg')
                          AND NOT bool_or(kind = 'default' AND key = 'jpeg')
                         THEN 'jpg' ELSE 'jpeg' END AS jpeg_extension
  FROM types GROUP BY container
),
renamed AS (
  SELECT container, '/' || part_name AS key FROM packed
  WHERE lang = 'en' AND {size('text')} >= 2000
),
new_types AS (
  SELECT * FROM types t WHERE kind = 'default' OR NOT EXISTS (
    SELECT 1 FROM renamed r WHERE r.container = t.container AND r.key = t.key)
  UNION ALL
  SELECT container, 'default', jpeg_extension, 'image/jpeg' FROM extensions e
  WHERE EXISTS (SELECT 1 FROM renamed r WHERE r.container = e.container)
    AND NOT EXISTS (SELECT 1 FROM types t WHERE t.container = e.container
                    AND t.kind = 'default' AND t.key = e.jpeg_extension)
)"""

CODES = ("click", "error", "purchase", "signup", "view")

POLLS = """
readings AS (
  SELECT CAST(user_id AS VARCHAR) AS device_id, strftime(ts, '%Y-%m-%d') AS poll_id,
         event_id AS pos, event_type AS code, value
  FROM events
),
first_polls AS (SELECT device_id, min(poll_id) AS poll_id FROM readings GROUP BY 1),
header_codes AS (
  SELECT DISTINCT device_id, code FROM readings JOIN first_polls USING (device_id, poll_id)
)"""

PACK = "'pack' || (doc_id // 25) || '.docx'"
PACKED = f"""
packed AS (
  SELECT {PACK} AS container, doc_id, lang, text, 'word/media/doc' || doc_id || {EXT} AS part_name,
         {EXT} AS extension,
         CASE WHEN lang = 'en' OR (lang = 'fr' AND n_chars >= 5000) THEN unhex('89504E470D0A1A0A')
              WHEN lang = 'fr' THEN unhex('FFD8FF') ELSE unhex('') END AS magic,
         CASE WHEN lang = 'en' OR (lang = 'fr' AND n_chars >= 5000)
                THEN unhex('89504E47') || encode(regexp_replace(
                     chr(13) || chr(10) || chr(26) || chr(10) || text, {WS}, ' ', 'g'))
              WHEN lang = 'fr' THEN unhex('FFD8FF') || encode({COLLAPSED}) END AS recoded,
         CASE WHEN lang = 'en' OR (lang = 'fr' AND n_chars >= 5000) THEN 'PNG'
              WHEN lang = 'fr' THEN 'JPEG' WHEN starts_with(text, 'BM') THEN 'BMP'
              WHEN starts_with(text, 'GIF8') THEN 'GIF' END AS format
  FROM documents
),
stored AS (
  SELECT *, magic || encode(text) AS content,
         CAST(octet_length(magic || encode(text)) AS BIGINT) AS file_size,
         CAST(octet_length(recoded) AS BIGINT) AS new_size
  FROM packed
),
checked AS (
  SELECT *, {KEPT} AS kept,
         CASE WHEN format IS NULL THEN 'formato desconhecido (mantida)'
              WHEN format NOT IN ('PNG', 'JPEG') THEN 'formato ' || format || ' (mantida)'
              WHEN (format = 'PNG') <> (extension = '.png') THEN '{fv.KEPT_MISMATCH}' END AS clash
  FROM stored
),
passed AS (
  SELECT *, kept IS NULL AND clash IS NULL AND new_size < file_size AS accepted,
         coalesce(kept, clash, CASE WHEN new_size >= file_size THEN '{fv.KEPT_NOT_SMALLER}' END)
           AS reason
  FROM checked
)"""

VECTORS = """
vectors AS (
  SELECT vec_id, label, 'pack' || (vec_id // 25) || '.docx' AS container,
         label = 0 AND list_min(embedding) < 0 AS has_alpha,
         CAST(len(list_distinct(list_transform(embedding,
           lambda v: floor((CAST(v AS DOUBLE) + 1) * 128)))) ** 2 AS INTEGER) AS colors
  FROM embeddings
),
photos AS (SELECT *, NOT has_alpha AND colors > 500 AS converted FROM vectors)"""


# Reports: masked sizes, one list of lines for each package.

HEAD_1 = [fv.REPORT_TITLE, "Entrada: in", "Saída:   out", fv.REPORT_PARAMETERS % (1600, 80, 1), fv.RULE_LINE]
HEAD_2 = [
    fv.REPORT_TITLE_2, "Entrada: in", "Saída:   out",
    (fv.REPORT_PARAMETERS_2 % (80, 1, 500, 5.0)).replace("5 %", "# %"), fv.RULE_LINE,
]
REPORTED_1 = """
c AS (
  SELECT container, count(*) AS media, count(*) FILTER (accepted) AS done,
         count(*) FILTER (extension = '.png') AS pngs, count(*) FILTER (lang <> 'fr') AS paragraphs,
         count(*) FILTER (lang = 'fr') AS tables, count(*) FILTER (lang = 'en') AS images
  FROM passed GROUP BY container
)"""
REPORTED_2 = """
c AS (
  SELECT container, count(*) AS media, count(*) FILTER (converted) AS done FROM photos GROUP BY container
)"""
LINES_1 = f"""[
  '', 'ARQUIVO: ' || container, '  Tamanho antes:  # MB',
  '  Validação: imagens: ' || media || ' = ' || media || ' OK; partes XML intactas (CRC) OK',
  '  Validação: parágrafos: ' || paragraphs || ' OK; tabelas: ' || tables || ' OK; imagens inline: '
    || images || ' OK',
  '  Tamanho depois: # MB', '  Redução:        # %',
  '  Imagens processadas: ' || done || ' | puladas: ' || (media - done)]"""
LINES_2 = f"""[
  '', 'ARQUIVO: ' || container, '  Tamanho antes: # MB',
  CASE WHEN done = 0 THEN '{fv.LINE_UNCHANGED}' END,
  CASE WHEN done > 0 THEN '  Validação: ' || (media + 3 - done)
    || ' partes não convertidas permanecem byte a byte idênticas (CRC) OK' END,
  CASE WHEN done > 0 THEN '  Validação: imagens: ' || media || ' = ' || media || ' OK; ' || done
    || ' JPEG(s) convertido(s) e íntegro(s) OK' END,
  CASE WHEN done > 0 THEN '  Validação: {fv.VALID_RELS_2}' END,
  CASE WHEN done > 0 THEN '  Validação: {fv.VALID_TYPES_2}' END,
  CASE WHEN done > 0 THEN '  Validação: parágrafos: ' || media || ' OK; tabelas: 0 OK; imagens inline: '
    || media || ' OK' END,
  '  Tamanho depois: # MB', '  Redução:        # %',
  '  PNGs convertidos: ' || done || ' | mantidos como PNG: ' || (media - done)]"""
SUMMARY_1 = f"""['', '{fv.RULE_LINE}', '{fv.SUMMARY_TITLE}',
  '  Arquivos processados: ' || count(*) || ' | com falha (original mantido): 0',
  '  Total antes:  # MB', '  Total depois: # MB', '  Redução total: # %', '']"""
SUMMARY_2 = SUMMARY_1.replace(fv.SUMMARY_TITLE, fv.SUMMARY_TITLE_2).replace("original mantido", "entrada mantida")


def _report(head: list[str], sections: str, lines: str, summary: str) -> str:
    quoted = ", ".join("'" + text.replace("'", "''") + "'" for text in head)
    return f"""SELECT * FROM (
          SELECT 0 AS block, '' AS container, unnest(range(5))::INT AS section, 0::BIGINT AS ordinal,
                 unnest([{quoted}]) AS line
          UNION ALL
          SELECT 1, container, unnest({sections}), 0, unnest({lines}) FROM c
          UNION ALL
          SELECT 2, '', unnest(range(8))::INT, 0, unnest({summary}) FROM c
        ) WHERE line IS NOT NULL"""


def _wide(source: str, condition: str = "true") -> str:
    columns = ", ".join(
        f"arg_max(value, pos) FILTER (code = '{c}' AND {condition}) AS {c}" for c in CODES
    )
    return (
        f"SELECT device_id, poll_id || ' 00:00:00' AS \"timestamp\", {columns} "
        f"FROM {source} GROUP BY device_id, poll_id"
    )


ORACLES: dict[str, str] = {
    "part_classes": f"""WITH {PARTS}, classed AS (SELECT *, {KEPT} AS reason FROM parts)
        SELECT container, ordinal, part_name, extension,
               CASE WHEN reason IS NULL THEN 'candidate' ELSE 'kept' END AS disposition, reason
        FROM classed""",
    "name_parts": r"""WITH n AS (
          SELECT page_id, url, regexp_extract(url, '[^/]*$') AS base FROM pages),
        e AS (SELECT *, regexp_extract(base, '^\.*[^.].*?(\.[^.]*)$', 1) AS raw FROM n)
        SELECT page_id, base, lower(raw) AS extension,
               left(url, length(url) - length(raw)) AS stem,
               starts_with(lower(replace('Word\Media/' || base, '\', '/')), 'word/media/') AS media
        FROM e""",
    "pass2_candidates": f"""WITH {PARTS} SELECT container, ordinal, part_name, file_size
        FROM parts WHERE extension = '.png' AND file_size >= 2000""",
    "oversize": "SELECT doc_id, source, n_chars FROM documents WHERE n_chars > 4000",
    "listing": """WITH n AS (SELECT page_id, regexp_extract(url, '[^/]*$') AS name FROM pages)
        SELECT page_id, name, row_number() OVER (ORDER BY name, page_id) AS ordinal,
               count(*) OVER () AS total
        FROM n WHERE lower(name) LIKE '%.html' AND NOT starts_with(name, '~$')""",
    "acceptance": f"""WITH {PARTS}
        SELECT ordinal, file_size AS old_size, new_size, new_size < file_size AS accepted_1,
               CASE WHEN new_size >= file_size THEN '{fv.KEPT_NOT_SMALLER}' END AS reason_1,
               NOT new_size > file_size * CAST(0.95 AS DOUBLE) AS accepted_2,
               CASE WHEN new_size > file_size * CAST(0.95 AS DOUBLE)
                    THEN '{fv.KEPT_NOT_ENOUGH}' END AS reason_2
        FROM parts""",
    "resize_plans": """WITH s AS (
          SELECT p_partkey, p_size * 100 AS width, CAST(floor(p_retailprice) AS INTEGER) AS height
          FROM part),
        m AS (SELECT *, greatest(width, height) AS longest FROM s)
        SELECT p_partkey, width, height,
          CASE WHEN longest <= 1600 THEN width ELSE CAST(greatest(1, round_even(
            width * (CAST(1600 AS DOUBLE) / longest), 0)) AS INTEGER) END AS new_width,
          CASE WHEN longest <= 1600 THEN height ELSE CAST(greatest(1, round_even(
            height * (CAST(1600 AS DOUBLE) / longest), 0)) AS INTEGER) END AS new_height,
          longest > 1600 AS resized
        FROM m""",
    "formatted_sizes": f"""WITH t AS (
          SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) * 10000 AS BIGINT) AS n
          FROM lineitem GROUP BY 1)
        SELECT l_orderkey, {mb('n')} AS size_text FROM t""",
    "reduction_percents": f"""WITH {PARTS}
        SELECT ordinal, {pct('file_size', 'new_size')} AS reduction_pct FROM parts""",
    "missing_labels": """SELECT doc_id, source FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
    "assigned_names": f"""WITH p AS (
          SELECT 'pkg' || (doc_id // 4) AS container, doc_id AS ordinal, {EXT} AS extension,
                 'word/media/img' || (doc_id // 2) AS stem
          FROM documents),
        n AS (
          SELECT *, row_number() OVER (PARTITION BY container, stem ORDER BY ordinal)
            + (SELECT count(*) > 0 FROM p q WHERE q.container = p.container
               AND q.stem = p.stem AND q.extension = '.jpeg')::INTEGER AS slot
          FROM p WHERE extension = '.png')
        SELECT container, ordinal, stem || '.png' AS part_name,
               stem || CASE WHEN slot = 1 THEN '' ELSE '_conv' || slot END || '.jpeg'
                 AS new_part_name
        FROM n""",
    "outcome_per_container": f"WITH {DECISIONS} SELECT * FROM outcomes",
    "detail_lines": f"""WITH {DECISIONS}
        SELECT container, ordinal, '    - ' || part_name || ': ' ||
          CASE WHEN accepted THEN {mb('old_size')} || ' -> ' || {mb('new_size')}
               ELSE reason END AS line
        FROM decisions""",
    "corpus_summary": f"""WITH {DECISIONS},
        s AS (SELECT count(*) AS files, count(*) FILTER (reduction_pct < 1) AS failures,
                     CAST(sum(size_before) AS BIGINT) AS total_before,
                     CAST(sum(size_after) AS BIGINT) AS total_after FROM outcomes)
        SELECT *, {pct('total_before', 'total_after')} AS reduction_pct,
               {mb('total_before')} AS before_text, {mb('total_after')} AS after_text FROM s""",
    "over_limit": f"""WITH {DECISIONS},
        w AS (SELECT container, CAST(coalesce(sum(compress_size), 0) AS BIGINT) AS weight,
                     count(*) AS parts FROM parts WHERE extension = '.png' GROUP BY 1)
        SELECT container, size_after, coalesce(weight, 0) AS weight, coalesce(parts, 0) AS parts,
               CAST(coalesce(weight, 0) AS DOUBLE) / CAST(size_after AS DOUBLE) * 100 AS weight_pct
        FROM outcomes LEFT JOIN w USING (container) WHERE size_after > 100000""",
    "media_weight": f"""WITH {PARTS}
        SELECT container,
               CAST(coalesce(sum(compress_size) FILTER (extension = '.png'), 0) AS BIGINT) AS weight,
               count(*) FILTER (extension = '.png') AS parts
        FROM parts GROUP BY container""",
    "media_counts": f"""WITH {ALTERED}
        SELECT container, count(DISTINCT part_name) FILTER (part_name LIKE 'word/media/%')
          AS media_count FROM altered GROUP BY container""",
    "manifest_diff": f"WITH {DIFF} SELECT * FROM diff WHERE status IS NOT NULL",
    "member_diff": f"""WITH {DIFF}
        SELECT container,
          coalesce(array_to_string(list_sort(list(part_name) FILTER (status = 'missing'))[1:5], ','),
                   '') AS missing,
          coalesce(array_to_string(list_sort(list(part_name) FILTER (status = 'extra'))[1:5], ','),
                   '') AS extra
        FROM diff WHERE status IN ('missing', 'extra') GROUP BY container""",
    "manifest_diff_renamed": f"""WITH {PARTS}, {ALTERED},
        b AS (SELECT container, replace(part_name, '.png', '.jpeg') AS part_name, ordinal, crc,
                     file_size, extension = '.png' AS renamed FROM parts),
        a AS (SELECT container, replace(part_name, '.png', '.jpeg') AS part_name, ordinal, crc,
                     file_size FROM altered),
        d AS (
          SELECT coalesce(b.container, a.container) AS container,
                 coalesce(b.part_name, a.part_name) AS part_name,
                 CASE WHEN a.part_name IS NULL THEN 'missing'
                      WHEN b.part_name IS NULL THEN 'extra'
                      WHEN NOT b.renamed AND (b.crc <> a.crc OR b.file_size <> a.file_size)
                        THEN 'changed' END AS status,
                 coalesce(a.ordinal, b.ordinal) AS ordinal
          FROM b FULL JOIN a ON b.container = a.container AND b.part_name = a.part_name)
        SELECT * FROM d WHERE status IS NOT NULL""",
    "manifest_violations": f"WITH {VIOLATIONS} SELECT * EXCLUDE (subject) FROM violations",
    "first_violation": f"""WITH {VIOLATIONS}
        SELECT container, min(rule_no) AS rule_no, arg_min(message, rule_no) AS message,
               count(*) AS findings FROM violations GROUP BY container""",
    "selected_versions": f"""WITH f AS (
          SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'poor' END AS failure
          FROM labels WHERE toxic = 1 OR quality = 0)
        SELECT doc_id AS container, failure,
               CASE WHEN failure IS NOT NULL THEN 'original'
                    WHEN lang = 'en' AND {size('text')} >= 2000 THEN 'new'
                    ELSE 'unchanged' END AS version
        FROM documents LEFT JOIN f USING (doc_id)""",
    "count_diff": f"""WITH {PARTS}, {ALTERED},
        b AS (SELECT container, count(*) FILTER (extension = '.png') AS p,
                     count(*) FILTER (extension = '.jpeg') AS t,
                     count(*) FILTER (extension = '.gif') AS i FROM parts GROUP BY 1),
        a AS (SELECT container, count(*) FILTER (extension = '.png') AS p,
                     count(*) FILTER (extension = '.jpeg') AS t,
                     count(*) FILTER (extension = '.gif') AS i FROM altered GROUP BY 1)
        SELECT container, b.p AS paragraphs_before, b.t AS tables_before,
               b.i AS inline_images_before, a.p AS paragraphs_after, a.t AS tables_after,
               a.i AS inline_images_after
        FROM b JOIN a USING (container) WHERE (b.p, b.t, b.i) <> (a.p, a.t, a.i)""",
    "resolve_targets": f"""WITH {REFERENCES}
        SELECT rels_path, pos, target, internal, resolved FROM resolved""",
    "rewrite_references": f"""WITH {REFERENCES}
        SELECT container, rels_path, pos, target, new_target, changed FROM rewritten2""",
    "changed_rels": f"""WITH {REFERENCES}
        SELECT container, rels_path, bool_or(changed) AS changed,
               count(*) FILTER (changed) AS changed_references
        FROM rewritten2 GROUP BY container, rels_path""",
    "relationship_diff": f"""WITH {REFERENCES},
        after AS (
          SELECT *, suffix(target, ',') AS lost,
                 suffix(target, 's') AND rel_type = '{IMAGE}' AS retyped,
                 CASE WHEN suffix(target, 'r') THEN new_target || 'x' ELSE new_target END AS got
          FROM rewritten2),
        found AS (
          SELECT *, CASE WHEN lost THEN '{fv.BAD_REL_IDS}'
            WHEN retyped THEN format('{fv.BAD_REL_TYPE.replace("%s", "{}")}', rel_id)
            WHEN got = target THEN NULL
            WHEN rel_type <> '{IMAGE}'
              THEN format('{fv.BAD_REL_NOT_IMAGE.replace("%s", "{}")}', rel_id)
            WHEN new_part IS NULL
              THEN format('{fv.BAD_REL_NOT_RENAMED.replace("%s", "{}")}', rel_id)
            WHEN got <> expected
              THEN format('{fv.BAD_REL_TARGET.replace("%s", "{}")}', rel_id, got) END AS finding
          FROM after)
        SELECT container, 6 AS rule_no, CAST(CASE WHEN lost THEN -1 ELSE pos END AS BIGINT) AS ordinal,
               rels_path || '#' || rel_id AS subject, rels_path || ': ' || finding AS message
        FROM found WHERE finding IS NOT NULL""",
    "jpeg_extensions": f"WITH {TYPES} SELECT container, jpeg_extension FROM extensions",
    "rewrite_content_types": f"WITH {TYPES} SELECT * FROM new_types",
    "content_type_diff": f"""WITH {TYPES},
        after AS (
          SELECT container, kind, CASE WHEN key = 'gif' THEN 'bmp' ELSE key END AS key,
                 CASE WHEN suffix(key, '7.png') THEN 'text/plain' ELSE content_type END AS content_type
          FROM new_types WHERE key <> 'emf' AND NOT suffix(key, '3.png')),
        j AS (
          SELECT coalesce(b.container, a.container) AS container, coalesce(b.kind, a.kind) AS kind,
                 coalesce(b.key, a.key) AS key, b.content_type AS type_before, a.content_type AS type_after,
                 b.key IS NULL AS added, a.key IS NULL AS lost
          FROM types b FULL JOIN after a
            ON b.container = a.container AND b.kind = a.kind AND b.key = a.key),
        o AS (
          SELECT *, CASE WHEN kind = 'default' AND lost THEN 0
            WHEN kind = 'default' AND added AND key NOT IN ('jpeg', 'jpg') THEN 1
            WHEN kind = 'override' AND lost AND NOT EXISTS (
              SELECT 1 FROM renamed r WHERE r.container = j.container AND r.key = j.key) THEN 2
            WHEN kind = 'override' AND added THEN 3
            WHEN kind = 'override' AND NOT lost AND type_before <> type_after THEN 4 END AS rule
          FROM j)
        SELECT container, 7 AS rule_no, CAST(rule AS BIGINT) AS ordinal,
               kind || ':' || key AS subject, '[Content_Types].xml: ' || CASE rule
                 WHEN 0 THEN '{fv.BAD_DEFAULT_LOST}'
                 WHEN 1 THEN '{fv.BAD_DEFAULT_ADDED[:-2]}' || '{{''' || key || '''}}'
                 WHEN 2 THEN '{fv.BAD_OVERRIDE_LOST[:-2]}' || '{{''' || key || '''}}'
                 WHEN 3 THEN '{fv.BAD_OVERRIDE_ADDED}'
                 ELSE 'ContentType de ' || key || ' alterado' END AS message
        FROM o WHERE rule IS NOT NULL""".replace("{{", "{").replace("}}", "}"),
    "split_events": """SELECT event_id, event_type <> 'error' AS success,
        CASE WHEN event_type <> 'error' THEN 'reading' ELSE 'error' END AS side FROM events""",
    "explained_errors": """WITH e AS (
          SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS code,
                 strftime(ts, '%H:%M') AS msg FROM events WHERE event_type = 'error')
        SELECT event_id, 'poll (code=' || code || '): ' || msg
               || coalesce(chr(10) || 'Dica: ' || n_name, '') AS message
        FROM e LEFT JOIN nation ON code = n_nationkey""",
    "stamped_polls": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events",
    "rescaled_readings": """SELECT event_id AS pos, event_type AS code,
        CASE WHEN event_type IN ('click', 'view') THEN CAST(format('{:.1f}', value / 10) AS DOUBLE)
             ELSE value END AS value FROM events""",
    "rescaled_tenths": """SELECT l_orderkey, l_linenumber, l_partkey,
        CAST(format('{:.1f}', l_extendedprice / 10) AS DOUBLE) AS tenth FROM lineitem""",
    "latest_per_code": f"""WITH {POLLS}
        SELECT device_id, poll_id, code, max(pos) AS pos, arg_max(value, pos) AS value
        FROM readings GROUP BY device_id, poll_id, code""",
    "wide_polls": f"WITH {POLLS} {_wide('readings')}",
    "headers": f"""WITH {POLLS}
        SELECT device_id, string_agg(code, ',' ORDER BY code) AS codes
        FROM header_codes GROUP BY device_id""",
    "drift": f"""WITH {POLLS},
        d AS (SELECT DISTINCT device_id, poll_id, code FROM readings r WHERE NOT EXISTS (
          SELECT 1 FROM header_codes h WHERE h.device_id = r.device_id AND h.code = r.code))
        SELECT device_id, poll_id, string_agg(code, ',' ORDER BY code) AS new_codes
        FROM d GROUP BY device_id, poll_id""",
    "locked_append": f"""WITH {POLLS},
        marked AS (SELECT r.*, h.code IS NOT NULL AS known
          FROM readings r LEFT JOIN header_codes h USING (device_id, code))
        {_wide('marked', 'known')}""",
    "empty_polls": """SELECT page_id,
        CAST(len(regexp_extract_all(html, 'href="(/[A-Z][^"]*)"', 1)) AS INTEGER) AS readings
        FROM pages""",
    "status_intake": """WITH e AS (
          SELECT CAST(user_id AS VARCHAR) AS device_id, event_type = 'error' AS failed,
                 CAST(format('{:.1f}', CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) / 10)
                      AS DECIMAL(18,1)) AS k FROM events)
        SELECT device_id, nullif(2 * count(*) FILTER (NOT failed), 0) AS readings,
               CAST(sum(k) FILTER (NOT failed) AS DOUBLE) AS k_total,
               nullif(count(*) FILTER (failed), 0) AS errors,
               max('poll (code=1106): denied' || chr(10) || 'Dica: ask again') FILTER (failed)
                 AS message
        FROM e GROUP BY device_id""",
    "streamed_rows": """WITH e AS (
          SELECT CAST(user_id AS VARCHAR) AS device_id, CAST(event_id AS VARCHAR) AS poll_id, ts,
                 event_type, value,
                 CAST(format('{:.1f}', CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) / 10)
                      AS DOUBLE) AS k
          FROM events WHERE event_type <> 'error'),
        h AS (SELECT device_id, arg_min(event_type, (ts, poll_id)) AS code FROM e GROUP BY 1)
        SELECT device_id, poll_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp", k,
               CASE WHEN event_type = code AND code = 'click' THEN value END AS click,
               CASE WHEN event_type = code AND code = 'purchase' THEN value END AS purchase,
               CASE WHEN event_type = code AND code = 'signup' THEN value END AS signup,
               CASE WHEN event_type = code AND code = 'view' THEN value END AS view
        FROM e JOIN h USING (device_id)""",
    "package_listing": f"""WITH {PACKED}
        SELECT container, CAST(row_number() OVER (PARTITION BY container ORDER BY doc_id) + 2
                               AS INTEGER) AS ordinal, part_name, false AS is_dir FROM packed
        UNION ALL
        SELECT container, i, name, false FROM (SELECT DISTINCT container FROM packed),
          (VALUES (0, '[Content_Types].xml'), (1, 'word/document.xml'),
                  (2, 'word/_rels/document.xml.rels')) AS x(i, name)""",
    "package_checksums": f"""WITH {PACKED}
        SELECT container, part_name, file_size, md5(content) AS digest, true AS crc_ok
        FROM stored""",
    "package_tests": f"""SELECT {PACK} AS container, count(*) + 3 AS parts, true AS crc_ok
        FROM documents GROUP BY 1""",
    "package_relationships": f"""WITH {PACKED}
        SELECT container, 'rId' || doc_id AS rel_id, substr(part_name, 6) AS target,
               part_name AS resolved FROM packed""",
    "package_content_types": f"""WITH {PACKED}
        SELECT DISTINCT container, 'default' AS kind, ltrim(extension, '.') AS key,
               'image/' || ltrim(extension, '.') AS content_type FROM packed
        UNION ALL
        SELECT DISTINCT container, 'override', '/word/document.xml', 'main+xml' FROM packed""",
    "package_structure": f"""SELECT {PACK} AS container,
        CAST(count(*) FILTER (lang <> 'fr') AS INTEGER) AS paragraphs,
        CAST(count(*) FILTER (lang = 'fr') AS INTEGER) AS tables,
        CAST(count(*) FILTER (lang = 'en') AS INTEGER) AS inline_images
        FROM documents GROUP BY 1""",
    "package_required": f"""SELECT {PACK} AS container FROM documents GROUP BY 1
        HAVING count(*) FILTER (lang NOT IN ('en', 'fr', 'de')) = 0""",
    "format_checks": f"""WITH {PACKED}
        SELECT container, part_name, coalesce(format, '?') AS format, clash AS reason
        FROM checked""",
    "recoded_parts": f"""WITH {PACKED}
        SELECT container, part_name, file_size AS old_size, new_size, new_size < file_size AS accepted,
               CASE WHEN new_size >= file_size THEN '{fv.KEPT_NOT_SMALLER}' END AS reason
        FROM checked WHERE kept IS NULL""",
    "first_pass_outcomes": f"""WITH {PACKED}
        SELECT container, 'new' AS version, count(*) FILTER (accepted) AS processed,
               count(*) FILTER (NOT accepted) AS skipped,
               count(*) FILTER (accepted) AS published_count, true AS proven,
               count(*) AS media_count,
               CAST(count(*) FILTER (lang <> 'fr') AS INTEGER) AS paragraphs,
               CAST(count(*) FILTER (lang = 'fr') AS INTEGER) AS tables,
               CAST(count(*) FILTER (lang = 'en') AS INTEGER) AS inline_images
        FROM passed GROUP BY container""",
    "first_pass_published": f"""WITH {PACKED},
        p AS (SELECT container, part_name,
                     CASE WHEN accepted THEN recoded ELSE content END AS content FROM passed)
        SELECT container, part_name, CAST(octet_length(content) AS INTEGER) AS size,
               md5(content) AS digest FROM p""",
    "first_pass_report": f"""WITH {PACKED}, {REPORTED_1}
        {_report(HEAD_1, "[0, 1, 2, 4, 5, 8, 9, 10]", LINES_1, SUMMARY_1)}
        UNION ALL
        SELECT 1, container, 50, row_number() OVER (PARTITION BY container ORDER BY doc_id) + 2,
          '    - ' || part_name || ': ' ||
          CASE WHEN accepted THEN {mb('file_size')} || ' -> ' || {mb('new_size')}
               ELSE reason END
        FROM passed
        UNION ALL
        SELECT 3, '', 0, 0, '  ATENÇÃO: ' || count(*) || ' arquivo(s) ainda acima de 100 MB:' FROM c
        UNION ALL
        SELECT 3, container, 0, 0, '    - ' || container || ': # MB | PNGs em word/media: ' || pngs
          || ' arquivo(s), # MB (# % do peso)' FROM c
        UNION ALL
        SELECT 4, '', i, 0, hint FROM (VALUES (0, '{fv.OVER_HINT[0]}'), (1, '{fv.OVER_HINT[1]}')) AS t(i, hint)""",
    "second_pass_report": f"""WITH {VECTORS}, {REPORTED_2}
        {_report(HEAD_2, "[0, 1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 13]", LINES_2, SUMMARY_2)}
        UNION ALL
        SELECT 1, container, 50, row_number() OVER (PARTITION BY container ORDER BY vec_id) + 2,
          '    - word/media/vec' || vec_id || '.png' ||
          CASE WHEN converted THEN ' -> word/media/vec' || vec_id || '.jpeg: # MB -> # MB'
               WHEN has_alpha THEN ': {fv.KEPT_ALPHA}' ELSE ': {fv.KEPT_FEW_COLORS}' END
        FROM photos
        UNION ALL
        SELECT 3, '', 0, 0, '  Ainda acima de 100 MB após a 2ª passada: ' || count(*) || ' arquivo(s):' FROM c
        UNION ALL
        SELECT 3, container, 0, 0, '    - ' || container || ': # MB' FROM c""",
    "second_pass_xml": f"""WITH {VECTORS}
        SELECT container, 'reference' AS kind, 'rId' || vec_id AS key,
               '{IMAGE} media/vec' || vec_id || CASE WHEN converted THEN '.jpeg' ELSE '.png' END AS value
        FROM photos
        UNION ALL SELECT DISTINCT container, 'default', 'png', 'image/png' FROM photos
        UNION ALL SELECT DISTINCT container, 'default', 'jpeg', 'image/jpeg' FROM photos WHERE converted
        UNION ALL SELECT DISTINCT container, 'override', '/word/document.xml', 'main+xml' FROM photos""",
    "picture_heads": f"""WITH {VECTORS}
        SELECT container, 'word/media/vec' || vec_id || '.png' AS part_name, 'PNG' AS head_format,
               64 AS head_width, 64 AS head_height, CASE WHEN label = 0 THEN 4 ELSE 3 END AS head_channels
        FROM vectors""",
    "image_flags": f"""WITH {VECTORS}
        SELECT 'word/media/vec' || vec_id || '.png' AS part_name, 64 AS width, 64 AS height,
               CASE WHEN label = 0 THEN 4 ELSE 3 END AS channels, true AS decodable, has_alpha,
               colors AS sample_colors, colors > 500 AS photographic
        FROM vectors""",
    "second_pass_outcomes": f"""WITH {VECTORS}
        SELECT container, CASE WHEN bool_or(converted) THEN 'new' ELSE 'unchanged' END AS version,
               count(*) FILTER (converted) AS processed,
               count(*) FILTER (NOT converted) AS skipped,
               count(*) FILTER (converted) AS published_count, true AS proven,
               count(*) AS media_count, count(*) + 3 AS members
        FROM photos GROUP BY container""",
    "second_pass_published": f"""WITH {VECTORS}
        SELECT container, CAST(row_number() OVER (PARTITION BY container ORDER BY vec_id) + 2
                               AS INTEGER) AS ordinal,
               'word/media/vec' || vec_id || CASE WHEN converted THEN '.jpeg' ELSE '.png' END
                 AS part_name
        FROM photos
        UNION ALL
        SELECT container, i, name FROM (SELECT DISTINCT container FROM photos),
          (VALUES (0, '[Content_Types].xml'), (1, 'word/document.xml'),
                  (2, 'word/_rels/document.xml.rels')) AS x(i, name)""",
    "streamed_corpus": f"""WITH {PACKED}
        SELECT container, 'new' AS version, count(*) FILTER (accepted) AS processed,
               count(*) FILTER (NOT accepted) AS skipped
        FROM passed GROUP BY container""",
}
