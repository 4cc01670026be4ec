"""DuckDB SQL for the registered queries, written from the definitions and not from the Spark code.

RE2 has neither look-around nor a Unicode \\b, so words are cut from wider runs.
"""

from __future__ import annotations

from staycoder.functions import fixed, prompts
from verification.solver import softmax_fit, softmax_predict

ORACLES: dict[str, str] = {}


# the fixed patterns, as RE2 takes them
CODE, DOTTED, UPPER = (p.removeprefix("(?U)") for p in (fixed.ICD10, fixed.DOTTED_ABBREVIATION, fixed.UPPER_ABBREVIATION))
UPPER = UPPER.replace(r"\b", "")


def text_sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# ---- expressions ---------------------------------------------------------------------------------


def words(t: str) -> str:
    return (
        rf"list_filter(list_transform(regexp_extract_all({t}, '[\p{{L}}\p{{N}}\p{{M}}_/\-]+'), lambda x: "
        rf"regexp_replace(regexp_replace(x, '^([\-/]|_[\p{{L}}\p{{N}}_]*)*', ''), '[\-/]+$', '')), lambda x: x <> '')"
    )


def sentence_list(t: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({t}, '[.!?;\\n]+'), lambda x: trim(x, {BLANKS})), lambda x: x <> '')"


BLANKS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"


def metric_list(t: str, suffix: str = "") -> str:
    """The six metrics of a text expression as select items."""
    n_words, n_sentences = f"len({words(t)})", f"len({sentence_list(t)})"
    items = {
        "len_chars": f"length({t})::BIGINT",
        "len_words": f"{n_words}::BIGINT",
        "sent_len_avg": f"CASE WHEN {n_sentences} = 0 THEN 0.0::DOUBLE ELSE round_even({n_words}::DOUBLE / {n_sentences}, 3) END",
        "lexicon_size": f"len(list_distinct(list_transform({words(t)}, lambda x: strip_accents(lower(x)))))::BIGINT",
        "n_sections": rf"len(list_filter(regexp_split_to_array({t}, '\n{{2,}}'), lambda x: regexp_matches(x, '\S')))::BIGINT",
        "n_abbr": (
            f"(len(list_filter(regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '{UPPER}')))"
            f" + len(regexp_extract_all({t}, '{DOTTED}')))::BIGINT"
        ),
    }
    return ",\n".join(f"{items[m]} AS {m}{suffix}" for m in fixed.METRICS)


def normalized(t: str) -> str:
    return rf"regexp_replace(regexp_replace(trim({t}, {BLANKS}), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g')"


def icd10(t: str) -> str:
    return f"nullif(regexp_extract({t}, '{CODE}'), '')"


def coded(t: str, n: str) -> str:
    return f"({t} || ' code ' || chr((65 + {n} % 26)::INTEGER) || lpad(({n} % 100)::VARCHAR, 2, '0') || '.' || ({n} % 10)::VARCHAR || ' fin')"


def windows(source: str, keys: str, t: str, capacity: int, step: int, at_least_one: str | None = None) -> str:
    """Rows (keys, chunk_no, chunk_text); `at_least_one` is the text of a document without tokens."""
    first = f"CASE WHEN len(tk) = 0 THEN {at_least_one} ELSE array_to_string(tk[i * {step} + 1 : i * {step} + {capacity}], ' ') END"
    plain = f"array_to_string(tk[i * {step} + 1 : i * {step} + {capacity}], ' ')"
    least = 1 if at_least_one else 0
    return rf"""
        SELECT {keys}, i::BIGINT AS chunk_no, {first if at_least_one else plain} AS chunk_text
        FROM (
            SELECT *, unnest(range(CASE WHEN len(tk) = 0 THEN {least} WHEN len(tk) <= {capacity} THEN 1
                   ELSE ceil((len(tk) - {capacity}) / {step}::DOUBLE)::BIGINT + 1 END)) AS i
            FROM (SELECT *, list_filter(regexp_split_to_array({t}, '\s+'), lambda x: x <> '') AS tk FROM {source})
        )"""


def components(source: str, keys: str, value: str) -> str:
    return f"""
        SELECT {keys}, i::BIGINT AS i, round({value}[i + 1]::DOUBLE, 6) AS x
        FROM (SELECT *, unnest(range(len({value}))) AS i FROM ({source}))"""


def hashed(source: str, keys: str, features: int = 256) -> str:
    """Rows (keys, i, x): the components, not zero, of the hashed word counts of chunk_text, scaled to unit length."""
    return f"""(
        SELECT {keys}, i, n / sqrt(sum(n * n) OVER (PARTITION BY {keys})) AS x
        FROM (SELECT {keys}, ('0x' || md5(w)[1:8])::BIGINT % {features} AS i, count(*)::DOUBLE AS n
              FROM (SELECT {keys}, unnest({words('lower(chunk_text)')}) AS w FROM ({source})) GROUP BY ALL))"""


def hashed_documents(source: str, features: int = 256) -> str:
    """Rows (doc_id, x): mean of a document's window vectors, as a list of doubles with float precision."""
    return f"""(
        SELECT doc_id, list(coalesce(s / n, 0)::FLOAT::DOUBLE ORDER BY i) AS x
        FROM (SELECT doc_id, count(*) AS n, unnest(range({features})) AS i FROM ({source}) GROUP BY doc_id)
        LEFT JOIN (SELECT doc_id, i, sum(x) AS s FROM {hashed(source, 'doc_id, chunk_no', features)} GROUP BY doc_id, i) USING (doc_id, i)
        GROUP BY doc_id)"""


VECS = "(SELECT vec_id // 5 AS doc, vec_id % 5 AS chunk_no, vec_id, embedding, label FROM embeddings)"
PARTS = f"(SELECT doc, chunk_no, vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM {VECS})"


def pooled(how: str, where: str = "true") -> str:
    return f"SELECT doc, i::BIGINT AS i, round({how}, 6) AS x FROM {PARTS} WHERE {where} GROUP BY doc, i"


LANG_IDS = "(SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS label_id FROM (SELECT DISTINCT lang FROM documents))"

# ---- sources and sinks ---------------------------------------------------------------------------

ORACLES["scan_documents"] = """
SELECT doc_id::VARCHAR AS id_sejour, source AS id_patient, coalesce(text, '') AS text, lang AS gold_dp FROM documents"""

ORACLES["scan_csv"] = """
SELECT doc_id::VARCHAR AS id_sejour, NULL::VARCHAR AS id_patient,
       coalesce('"' || replace(text, ' ', ' "" ') || ',' || chr(10) || '"', '') AS text,
       CASE WHEN lang <> 'de' THEN lang END AS gold_dp
FROM documents"""

ORACLES["train_rows"] = """
SELECT doc_id, text, quality::VARCHAR AS quality FROM documents JOIN labels USING (doc_id)
WHERE text IS NOT NULL AND quality IS NOT NULL"""

PREDICTED = """(
SELECT doc_id, text, CASE WHEN source <> 'src0' THEN doc_id::VARCHAR ELSE '' END AS code_sejour,
       CASE WHEN quality IS NULL THEN '' ELSE 'Q' || quality::VARCHAR END AS dp_predit
FROM documents LEFT JOIN labels USING (doc_id))"""

ORACLES["prediction_output"] = f"SELECT code_sejour, dp_predit FROM {PREDICTED}"
ORACLES["prediction_with_metrics"] = f"""
SELECT code_sejour, dp_predit, {metric_list('text', '_before')}, {metric_list('text_rw', '_after')}
FROM (SELECT *, lower({normalized("replace(text, '.', '.  ')")}) AS text_rw FROM {PREDICTED})"""

ORACLES["run_summary"] = """
SELECT count(*) AS n_documents, count(quality) AS n_predicted FROM documents LEFT JOIN labels USING (doc_id)"""


def extracted(source: str, keys: str, lead: str, target: int) -> str:
    """Sentences with a lead first, then text order, while the word total stays within the target."""
    return f"""
    SELECT {keys}, coalesce(string_agg(s, '. ' ORDER BY pos) FILTER (total <= {target}), '') AS text_rw FROM (
        SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS total FROM (
            SELECT *, CASE WHEN s IS NULL THEN 0 ELSE len({words('s')}) END AS n,
                   row_number() OVER (PARTITION BY doc_id ORDER BY NOT coalesce({lead}, false), k) AS pos
            FROM (SELECT *, unnest(CASE WHEN len(ss) = 0 THEN [NULL] ELSE ss END) AS s,
                         unnest(range(greatest(len(ss), 1))) AS k
                  FROM (SELECT *, {sentence_list('text')} AS ss FROM {source}))
        )
    ) GROUP BY {keys}"""


def has_word(s: str, choices: str) -> str:
    """A whole word, any case; the borders are spelled out because RE2's \\b is ASCII-only."""
    other = r"[^\p{L}\p{N}\p{M}_]"
    return f"regexp_matches({s}, '(?i)(^|{other})({choices})($|{other})')"


CONCLUSION = has_word("s", "conclusion")
REWRITTEN = f"""(SELECT doc_id, lang, text, text_rw, {metric_list('text', '_before')}, {metric_list('text_rw', '_after')}
FROM ({extracted('documents', 'doc_id, lang, text', CONCLUSION, 100)}))"""
ORACLES["rewrite_dataset"] = f"SELECT * FROM {REWRITTEN}"
ORACLES["metrics_recap"] = "SELECT count(*) AS n_rows, " + ", ".join(
    f"round_even(sum({m}_{p}::DOUBLE) / count(*), 3) AS {m}_{p}" for m in fixed.METRICS for p in ("before", "after")
) + f" FROM {REWRITTEN}"

# ---- text ----------------------------------------------------------------------------------------

ROUGH = (
    "(' ' || chr(10) || chr(9) || replace(replace(text, '. ', '.  ' || chr(9) || ' '), chr(10), repeat(chr(10), 4))"
    " || chr(160) || ' ' || chr(10))"
)
ORACLES["normalize_text"] = f"SELECT doc_id, {normalized(ROUGH)} AS text_norm FROM documents"
ORACLES["normalize_pages"] = f"SELECT page_id, lower({normalized('html')}) AS text_norm FROM pages"
ORACLES["word_tokens"] = f"""
SELECT doc_id, len(w)::BIGINT AS n_words, array_to_string(w, ' ') AS words FROM (SELECT doc_id, {words('text')} AS w FROM documents)"""
ORACLES["sentences"] = f"""
SELECT doc_id, len(s)::BIGINT AS n_sentences, array_to_string(s, '|') AS sentences
FROM (SELECT doc_id, {sentence_list('text')} AS s FROM documents)"""
ORACLES["text_metrics"] = f"""
SELECT doc_id, {metric_list('text')} FROM (SELECT doc_id, replace(text, chr(10), repeat(chr(10), 3)) AS text FROM documents)"""
ORACLES["lexicon"] = f"""
SELECT doc_id, len(f)::BIGINT AS lexicon_size, array_to_string(list_sort(f), ' ') AS lexicon
FROM (SELECT doc_id, list_distinct(list_transform({words('text')}, lambda x: strip_accents(lower(x)))) AS f FROM documents)"""
ORACLES["strip_accents"] = "SELECT doc_id, strip_accents(text) AS plain FROM documents"
ORACLES["text_fallback"] = f"""
SELECT conv_id, turn,
       trim(CASE WHEN rw <> '' THEN rw WHEN norm <> '' THEN norm ELSE text END, {BLANKS}) AS for_chunks,
       CASE WHEN norm IS NOT NULL THEN norm ELSE text END AS for_rewrite,
       CASE WHEN rw <> '' THEN rw ELSE text END AS for_embedding,
       text AS for_classifier,
       CASE WHEN rw <> '' THEN rw WHEN norm <> '' THEN norm ELSE text END AS for_generation
FROM (SELECT *, CASE role WHEN 'user' THEN NULL WHEN 'system' THEN '' ELSE ' ' || text || ' ' END AS rw,
             CASE WHEN turn = 0 THEN '' WHEN turn > 2 THEN text END AS norm FROM conversations)"""

# ---- codes and prompts ---------------------------------------------------------------------------

ORACLES["first_icd10"] = f"SELECT doc_id, {icd10(coded('text', 'doc_id'))} AS code FROM documents"
ORACLES["answer_code"] = f"""
SELECT conv_id, turn, coalesce({icd10('last')}, {icd10('gen')}, '') AS code_full, coalesce({icd10('last')}, '') AS code_strict
FROM (SELECT *, split_part(gen, 'DP:', -1) AS last FROM (
    SELECT conv_id, turn, {coded('text', 'conv_id')} || chr(10) || chr(10) || CASE turn % 3
        WHEN 0 THEN 'DP: I21.4' WHEN 1 THEN 'DP: E11 DP: rien' ELSE 'sans reponse' END AS gen FROM conversations))"""
ORACLES["rewrite_prompt"] = f"""
SELECT doc_id, 'system' AS role, {text_sql(prompts.REWRITE_ROLE)} AS content FROM documents WHERE text <> ''
UNION ALL
SELECT doc_id, 'user', {text_sql(prompts.REWRITE_REQUEST + ' (~300 mots) :')} || chr(10) || chr(10) || trim(text, {BLANKS})
FROM documents WHERE text <> ''"""
CODING = f"{text_sql(prompts.CODING_REQUEST)} || chr(10) || chr(10) || %s || chr(10) || chr(10) || 'DP:'"
ORACLES["coding_prompt"] = f"""
SELECT conv_id, turn, CASE WHEN role <> 'system' THEN {CODING % f'trim(text, {BLANKS})'} END AS prompt FROM conversations"""
ORACLES["normalize_code"] = """
SELECT doc_id, raw AS plain, upper(raw) AS upper, replace(upper(raw), '.', '') AS bare
FROM (SELECT doc_id, CASE WHEN lang <> 'es' THEN source || '.' || lang ELSE '' END AS raw FROM documents)"""

# ---- windows -------------------------------------------------------------------------------------

ORACLES["chunk_windows"] = windows("documents", "doc_id", "text", 48, 40)
ORACLES["labelled_chunks"] = f"""
SELECT doc_id, lang, chunk_no, chunk_text, label_id
FROM ({windows('documents', 'doc_id, lang', 'text', 478, 414, "''")}) JOIN {LANG_IDS} USING (lang)"""
ORACLES["first_window"] = rf"""
SELECT doc_id, lang, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[1:62], ' ') AS chunk_text, label_id
FROM documents JOIN {LANG_IDS} USING (lang)"""
ORACLES["chunk_fallback"] = windows(
    "(SELECT *, CASE WHEN role = 'system' THEN ' ' || chr(10) || ' ' ELSE text END AS note FROM conversations)",
    "conv_id, turn", "note", 48, 40, "note",
)

# ---- vectors -------------------------------------------------------------------------------------


def letters(t: str) -> str:
    return "[" + ", ".join(f"(length({t}) - length(replace({t}, '{c}', '')))::DOUBLE" for c in "aeiz") + "]"


ORACLES["embed_model"] = components(
    f"""SELECT doc_id, chunk_no, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) AS u
    FROM (SELECT *, {letters('chunk_text')} AS v FROM ({windows('documents', 'doc_id', 'text', 478, 414)}))""",
    "doc_id, chunk_no", "u",
)
ORACLES["pool_masked_mean"] = f"""
SELECT doc, i::BIGINT AS i, round(sum(x * m) / greatest(sum(m), 1), 6) AS x
FROM (SELECT *, CASE WHEN label % 3 <> 0 THEN 1 ELSE 0 END AS m FROM {PARTS}) GROUP BY doc, i"""
ORACLES["pool_first_token"] = """
SELECT vec_id // 16 AS chunk, i::BIGINT AS i, round(avg(x), 6) AS x
FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
WHERE (vec_id // 8) % 2 = 0 AND vec_id % 8 + 1 > 4 GROUP BY 1, i"""
ORACLES["l2_normalize"] = components(
    """SELECT vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) AS u
    FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 7)) AS v FROM embeddings)""",
    "vec_id", "u",
)
ORACLES["pool_chunks_mean"] = pooled("avg(x)::FLOAT::DOUBLE")
ORACLES["pool_chunks_max"] = pooled("max(x)")
ORACLES["pool_chunks_median"] = pooled("median(x)::FLOAT::DOUBLE")
ORACLES["pool_chunks_first"] = pooled("min(x)", "chunk_no = 0")
ORACLES["pool_logits_mean"] = pooled("avg(x)")
ORACLES["pool_logits_max"] = pooled("max(x)")
ORACLES["pool_logits_median"] = pooled("median(x)")

NAMES = "(SELECT DISTINCT label AS label_id, printf('C%02d', label) AS name FROM embeddings WHERE label < 8)"


def top_class(source: str, key: str) -> str:
    """Top logit per key, the lowest class on ties, with its softmax."""
    return f"""
    SELECT {key}, i AS label_id, 1 / total AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY x DESC, i) AS rk,
               sum(exp(x - top)) OVER (PARTITION BY {key}) AS total
        FROM (SELECT *, max(x) OVER (PARTITION BY {key}) AS top FROM {source})
    ) WHERE rk = 1"""


DOC_LOGITS = f"(SELECT doc, i, avg(x) AS x FROM {PARTS} GROUP BY doc, i)"
ORACLES["argmax_label"] = f"""
SELECT vec_id, label_id::BIGINT AS label_id, coalesce(name, label_id::VARCHAR) AS code
FROM ({top_class(PARTS, 'vec_id')}) LEFT JOIN {NAMES} USING (label_id)"""
ORACLES["softmax_score"] = f"SELECT vec_id, round(score, 6) AS score FROM ({top_class(PARTS, 'vec_id')})"
ORACLES["doc_classifier"] = f"""
SELECT doc, coalesce(name, label_id::VARCHAR) AS code, round(score, 6) AS score
FROM ({top_class(DOC_LOGITS, 'doc')}) LEFT JOIN {NAMES} USING (label_id)"""

# ---- models --------------------------------------------------------------------------------------

ORACLES["plugin_scoring"] = f"""
SELECT doc_id, CASE WHEN lang <> 'es' THEN v[1] + 2 * v[2] + 3 * v[3] END AS weighted
FROM (SELECT *, {letters('text')} AS v FROM documents)"""
ORACLES["rewrite_copy"] = "SELECT doc_id, CASE WHEN lang = 'en' THEN '' ELSE text END AS text_rw FROM documents"
ORACLES["rewrite_extract"] = extracted("documents", "doc_id", has_word("s", "das|los|les|by"), 60)
ORACLES["rewrite_model"] = f"""
SELECT doc_id, CASE WHEN lang = 'es' THEN '' ELSE trim({text_sql(prompts.REWRITE_REQUEST + ' (~50 mots) :')}
    || chr(10) || chr(10) || trim(text, {BLANKS}), {BLANKS}) END AS text_rw FROM documents"""
REQUEST = f"(trim({text_sql(prompts.REWRITE_REQUEST + ' (~50 mots) :')} || chr(10) || chr(10) || trim(text, {BLANKS}), {BLANKS}))"
ORACLES["rewrite_options"] = rf"""
SELECT doc_id, CASE WHEN lang = 'es' THEN '' ELSE array_to_string(regexp_split_to_array({REQUEST}, '\s+')[-12:], ' ') || ' @0.7' END AS text_rw
FROM documents"""
ORACLES["generation_options"] = f"""
SELECT doc_id, 'I' || (10 + length(p) % 90)::VARCHAR AS code FROM (SELECT doc_id, {CODING % f"trim(text, {BLANKS})"} AS p FROM documents)"""
ORACLES["generated_code"] = f"""
SELECT doc_id, coalesce({icd10("split_part(gen, 'DP:', -1)")}, {icd10('gen')}, '') AS code
FROM (SELECT doc_id, p || CASE WHEN length(p) % 2 = 1 THEN ' I21.4.' ELSE ' rien' END AS gen
      FROM (SELECT doc_id, {CODING % f"trim({coded('text', 'doc_id')}, {BLANKS})"} AS p FROM documents))"""
ORACLES["usable_train_rows"] = """
SELECT doc_id, quality::VARCHAR AS gold_dp FROM documents JOIN labels USING (doc_id)
JOIN embeddings ON vec_id = doc_id WHERE quality IS NOT NULL AND embedding IS NOT NULL"""
ORACLES["predict_linear"] = f"""
SELECT vec_id, class::BIGINT AS label_id FROM (
    SELECT vec_id, class, row_number() OVER (PARTITION BY vec_id ORDER BY dot DESC, class) AS rk FROM (
        SELECT p.vec_id, w.label AS class, sum(p.x * w.m) AS dot
        FROM {PARTS} p JOIN (SELECT label, i, avg(x) AS m FROM {PARTS} GROUP BY label, i) w USING (i)
        GROUP BY p.vec_id, w.label)
) WHERE rk = 1"""

ORACLES["embed_hashed"] = f"SELECT doc_id, chunk_no, i, round(x, 6) AS x FROM {hashed(windows('documents', 'doc_id', 'text', 478, 414), 'doc_id, chunk_no')}"

CODED = "SELECT vec_id, vec_id AS id, printf('C%02d', label) AS y, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings"
CLASS_WEIGHTS = f"(SELECT y, (inv / avg(inv) OVER ())::FLOAT::DOUBLE AS w FROM (SELECT y, 1.0::DOUBLE / count(*) AS inv FROM ({CODED}) GROUP BY y))"
HEAD_ROWS = f"SELECT id AS vec_id, y AS gold_dp, code, round(score, 4) AS score FROM {softmax_predict('rows')} JOIN rows USING (id)"
ORACLES["fit_head"] = softmax_fit(f"SELECT *, 1.0::DOUBLE AS w FROM ({CODED})") + HEAD_ROWS
ORACLES["fit_head_weighted"] = softmax_fit(f"SELECT * FROM ({CODED}) JOIN {CLASS_WEIGHTS} USING (y)") + HEAD_ROWS
ORACLES["predict_saved_head"] = softmax_fit(f"SELECT *, 1.0::DOUBLE AS w FROM ({CODED})", C=0.2) + HEAD_ROWS

# ---- scoring -------------------------------------------------------------------------------------

GUESS = """CASE WHEN contains(text, ' the ') THEN 'EN' WHEN contains(text, ' und ') THEN 'DE'
WHEN contains(text, ' les ') THEN 'FR' WHEN contains(text, ' los ') THEN 'ES' WHEN contains(text, ' a ') THEN '' ELSE 'XX' END"""
PAIRS = f"""(
SELECT g.id, g.gold_code, p.pred_code FROM
(SELECT CASE WHEN source <> 'src0' THEN doc_id END AS id, upper(lang) AS gold_code FROM documents) g
JOIN (SELECT doc_id AS id, {GUESS} AS pred_code FROM documents UNION ALL
      SELECT CASE WHEN turn > 0 THEN conv_id END, {GUESS} FROM conversations) p
ON g.id IS NOT DISTINCT FROM p.id WHERE gold_code <> '' AND pred_code <> '')"""
SHARED = f"""(
SELECT g.source AS id, upper(g.lang) AS gold_code, p.pred_code FROM documents g
JOIN (SELECT source, {GUESS} AS pred_code FROM documents) p USING (source) WHERE pred_code <> '')"""


def counts(pairs: str) -> str:
    return f"""(
    SELECT label, sum(s)::BIGINT AS support, sum(p)::BIGINT AS predicted, sum(t)::BIGINT AS true_positives FROM (
        SELECT gold_code AS label, 1 AS s, 0 AS p, CASE WHEN gold_code = pred_code THEN 1 ELSE 0 END AS t FROM {pairs}
        UNION ALL SELECT pred_code, 0, 1, 0 FROM {pairs}) GROUP BY label)"""


def class_scores(pairs: str) -> str:
    return f"""(
    SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE true_positives::DOUBLE / predicted END AS precision,
           CASE WHEN support = 0 THEN 0.0 ELSE true_positives::DOUBLE / support END AS recall,
           2.0::DOUBLE * true_positives / (support + predicted) AS f1 FROM {counts(pairs)})"""


def score_rows(pairs: str) -> str:
    acc = "sum(true_positives)::DOUBLE / sum(support)::DOUBLE"
    names = ("precision", "recall", "f1")
    select = {
        "micro": [f"{acc}" for _ in names],
        "macro": [f"avg({m})" for m in names],
        "weighted": [f"sum({m} * support) / sum(support)::DOUBLE" for m in names],
    }
    return " UNION ALL ".join(
        f"SELECT '{average}' AS average, sum(support)::BIGINT AS n_pairs, round({acc}, 6) AS accuracy, "
        + ", ".join(f"round({e}, 6) AS {m}" for e, m in zip(parts, names))
        + f" FROM {class_scores(pairs)}"
        for average, parts in select.items()
    )


ORACLES["eval_pairs"] = f"""
SELECT id::VARCHAR AS id, gold_code, pred_code, count(*) AS n_pairs FROM {PAIRS} GROUP BY ALL"""
ORACLES["confusion_counts"] = f"SELECT * FROM {counts(PAIRS)}"
ORACLES["eval_scores"] = score_rows(PAIRS)
ORACLES["eval_from_csv"] = f"SELECT * FROM ({score_rows(PAIRS)}) WHERE average = 'micro'"
ORACLES["eval_scores_shared_ids"] = score_rows(SHARED)
ORACLES["classification_report"] = f"""
SELECT 'class' AS kind, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
FROM {class_scores(PAIRS)}
UNION ALL SELECT 'accuracy', 'accuracy', NULL, NULL, accuracy, n_pairs FROM ({score_rows(PAIRS)}) WHERE average = 'micro'
UNION ALL SELECT 'average', average || ' avg', precision, recall, f1, n_pairs FROM ({score_rows(PAIRS)}) WHERE average <> 'micro'"""

# ---- labels and split ----------------------------------------------------------------------------

ORACLES["label_map"] = """
SELECT source AS label, row_number() OVER (ORDER BY source) - 1 AS label_id FROM (SELECT DISTINCT source FROM documents)"""
SPLIT = """(
SELECT doc_id, lang, CASE WHEN rk <= n_val THEN 'val' ELSE 'train' END AS split FROM (
    SELECT *, CASE WHEN n = 1 THEN 0 ELSE least(greatest(round_even(n * 0.1::DOUBLE, 0), 1), n - 1) END AS n_val FROM (
        SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n,
               row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id::VARCHAR), doc_id) AS rk FROM documents)))"""
ORACLES["per_class_split"] = f"SELECT doc_id, lang, split FROM {SPLIT}"
ORACLES["split_stats"] = f"SELECT split, lang AS label, count(*) AS n_rows FROM {SPLIT} GROUP BY split, lang"
ORACLES["class_weights"] = f"""
SELECT lang AS label, label_id, round((inv / avg(inv) OVER ())::FLOAT::DOUBLE, 5) AS weight FROM (
    SELECT lang, label_id, 1.0::DOUBLE / greatest(coalesce(n, 0), 1) AS inv FROM {LANG_IDS}
    LEFT JOIN (SELECT lang, count(*) AS n FROM {SPLIT} WHERE split = 'train' GROUP BY lang) USING (lang))"""

# ---- whole runs ----------------------------------------------------------------------------------

RUN_NORM = f"(SELECT doc_id, {normalized('text')} AS text_rw, text FROM documents)"
RUN_PARTS = f"""(SELECT doc_id, i, max(x) AS x FROM (
    SELECT doc_id, unnest(range(4)) AS i, unnest({letters('chunk_text')}) AS x
    FROM ({windows(RUN_NORM, 'doc_id', 'text_rw', 48, 40, 'text')})) GROUP BY doc_id, i)"""
RUN_VECTORS = hashed_documents(windows(RUN_NORM, "doc_id", "text_rw", 478, 414, "text"))
ORACLES["frozen_head_run"] = (
    softmax_fit(f"SELECT doc_id AS id, lang AS y, x, 1.0::DOUBLE AS w FROM {RUN_VECTORS} JOIN documents USING (doc_id)", gap=1e-8)
    + f"SELECT id::VARCHAR AS code_sejour, code AS dp_predit FROM {softmax_predict('rows')}"
)
LONG_WORDS = "array_to_string(list_filter(string_split(chunk_text, ' '), lambda w: length(w) > 1), ' ')"
ORACLES["token_encoder_run"] = f"""
SELECT doc_id AS doc_key, i, round(avg(v[i + 1] / greatest(sqrt(list_dot_product(v, v)), 1e-12))::FLOAT::DOUBLE, 6) AS x
FROM (SELECT doc_id, unnest(range(4)) AS i, {letters(LONG_WORDS)} AS v FROM ({windows(RUN_NORM, 'doc_id', 'text_rw', 48, 40, 'text')}))
GROUP BY doc_id, i"""
FIRST_WINDOWS = rf"""(
SELECT doc_id, 0 AS chunk_no, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[1:128], ' ') AS chunk_text
FROM documents)"""
TRAIN_WEIGHTS = f"""(
SELECT lang, (inv / avg(inv) OVER ())::FLOAT::DOUBLE AS w
FROM (SELECT lang, 1.0::DOUBLE / count(*) AS inv FROM {SPLIT} WHERE split = 'train' GROUP BY lang))"""


def train_rows(part: str) -> str:
    return f"""
SELECT doc_id AS id, lang AS y, list(coalesce(x, 0) ORDER BY i) AS x, any_value(w) AS w
FROM (SELECT doc_id, lang, w, unnest(range(256)) AS i FROM {SPLIT} JOIN {TRAIN_WEIGHTS} USING (lang) WHERE split = '{part}')
LEFT JOIN {hashed(FIRST_WINDOWS, 'doc_id, chunk_no')} USING (doc_id, i) GROUP BY doc_id, lang"""


ORACLES["weighted_train_run"] = (
    softmax_fit(train_rows("train"), C=2.0)
    + f", val AS ({train_rows('val')}) SELECT id AS doc_id, y AS lang, code, round(score, 4) AS score FROM {softmax_predict('val')} JOIN val USING (id)"
)
ORACLES["chunk_classifier_run"] = f"""
SELECT doc_id::VARCHAR AS code_sejour, label_id::VARCHAR AS dp_predit, {metric_list('text', '_before')}, {metric_list('text_rw', '_after')}
FROM ({top_class(RUN_PARTS, 'doc_id')}) JOIN {RUN_NORM} USING (doc_id)"""
ORACLES["generation_run"] = f"""
SELECT doc_id::VARCHAR AS code_sejour, coalesce({icd10("split_part(gen, 'DP:', -1)")}, {icd10('gen')}, '') AS dp_predit
FROM (SELECT doc_id, p || CASE WHEN length(p) % 2 = 1 THEN ' I21.4.' ELSE ' rien' END AS gen
      FROM (SELECT doc_id, {CODING % 'text_rw'} AS p FROM {RUN_NORM}))"""
