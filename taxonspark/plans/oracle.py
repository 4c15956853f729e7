"""DuckDB SQL for each registered query (the correctness oracle).

The SQL is written independently of the Spark plans: rule matching uses ``list_filter``
lambdas, nearest brand uses a full ``row_number()`` ranking, the cascade is one chain of
CTEs. Tables ``part``, ``documents``, ... are views registered by the checker.
"""

from __future__ import annotations

from ..functions.text import PY_WHITESPACE
from ..params import (DEFAULT_PARAMS, EMPTY_DESCRIPTION, METHOD_ERROR, METHOD_NONE, METHOD_NOT_FOUND, METHOD_RULE,
                      METHOD_SEARCH_MATCHED, METHOD_SEARCH_UNMATCHED, METHOD_SIMILARITY, SUCCESS_METHODS)
from ..sources import fixtures as fx
from .catalog import RULE_SHEET_HEADER

P = DEFAULT_PARAMS
WS = "(" + " || ".join(f"chr({ord(c)})" for c in PY_WHITESPACE) + ")"


def s(x: str) -> str:
    """SQL string literal."""
    return "'" + x.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def cell(x: str) -> str:
    return f"coalesce({strip(x)}, '')"


def kw_list(x: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '[,，、]'), "
            f"lambda k: {strip('k')}), lambda k: k <> '')")


def pred(t: str, r: str = "", cols: dict | None = None) -> str:
    """J1 in SQL: ``t`` is the stripped text; rule arrays are ``{r}g1`` ... or ``cols``."""
    c = {g: f"{r}{g}" for g in ("g1", "g2", "g3", "g4", "g5", "must_not")}
    c.update(cols or {})
    live = " OR ".join(f"len({c[g]}) > 0" for g in ("g1", "g2", "g3", "g4", "g5"))
    all_of = " OR ".join(f"(len({c[g]}) > 0 AND len(list_filter({c[g]}, lambda k: NOT contains({t}, k))) = 0)"
                         for g in ("g1", "g2", "g3", "g4"))
    n14 = " + ".join(f"len({c[g]})" for g in ("g1", "g2", "g3", "g4"))
    return (f"({t} <> '' AND ({live}) "
            f"AND len(list_filter({c['must_not']}, lambda k: contains({t}, k))) = 0 "
            f"AND (len({c['g5']}) = 0 OR len(list_filter({c['g5']}, lambda k: contains({t}, k))) > 0) "
            f"AND (({n14}) = 0 OR {all_of}))")


def collapse(rel: str, key: str) -> str:
    return (f"SELECT {key}, "
            f"coalesce(string_agg({strip('level1')}, '；' ORDER BY rule_idx) FILTER (WHERE {strip('level1')} <> ''), '') AS level1, "
            f"coalesce(string_agg(code, '；' ORDER BY rule_idx) FILTER (WHERE code <> ''), '') AS code, "
            f"coalesce(string_agg({strip('atomic')}, '；' ORDER BY rule_idx) FILTER (WHERE {strip('atomic')} <> ''), '') AS atomic, "
            f"count(*)::BIGINT AS n_rules FROM {rel} GROUP BY {key}")


def score_sql(tv: str, bv: str, tt: str, bt: str, w: float = 0.5, combined: bool = True) -> str:
    cos01 = (f"(CASE WHEN {tv} IS NULL OR {bv} IS NULL THEN 0.0::DOUBLE "
             f"ELSE (list_dot_product({tv}::DOUBLE[], {bv}::DOUBLE[]) + 1.0) / 2.0 END)")
    if not combined:
        return f"least(greatest({cos01}, 0.0), 1.0)"
    jw = f"jaro_winkler_similarity({strip(tt)}, {strip(bt)})"
    return f"least(greatest({float(w)!r}::DOUBLE * {cos01} + {float(1.0 - w)!r}::DOUBLE * {jw}, 0.0), 1.0)"


def alias_list() -> str:
    return ", ".join(s(a) for a in P.unmatched_aliases)


# --------------------------------------------------------------------------- common CTEs

RULES = f"rules AS ({fx.rules_sql()})"
GROWN = "CASE WHEN p_partkey % 4 = 0 THEN p_name || ' ' || CAST(p_partkey AS VARCHAR) ELSE p_name END"
PART_LEADS = (f"pleads AS (SELECT p_partkey AS lead_idx, CAST(p_partkey AS VARCHAR) AS lead_code, {GROWN} AS lead_name, "
              "NULL::FLOAT[] AS embedding FROM part)")
DOC_LEADS = "dleads AS (SELECT doc_id AS lead_idx, text AS lead_name FROM documents)"
NAMED = ("nv AS (SELECT e.vec_id, e.label, e.embedding, coalesce(p.p_name, 'item') AS p_name, "
         "coalesce(p.p_name, 'item') || ' ' || CAST(e.vec_id AS VARCHAR) AS name FROM embeddings e LEFT JOIN part p ON p.p_partkey = e.vec_id)")
BRANDS = ("brands AS (SELECT vec_id AS brand_idx, CAST(vec_id AS VARCHAR) AS brand_code, name AS brand_name, "
          "'' AS brand_keywords, 'cat_' || CAST(label AS VARCHAR) AS atomic, embedding FROM nv WHERE vec_id % 2 = 1)")
VLEADS = ("vleads AS (SELECT vec_id AS lead_idx, CAST(vec_id AS VARCHAR) AS lead_code, name AS lead_name, embedding, p_name, label "
          "FROM nv)")
PDESC = (f"pdesc AS (SELECT DISTINCT p_name AS text, {fx.description_case_sql('p_name')} AS description FROM part "
         f"WHERE p_name IN {fx.description_names_sql()})")
VDESC = (f"vdesc AS (SELECT lead_name AS text, {fx.description_case_sql('p_name')} AS description FROM vleads "
         f"WHERE p_name IN {fx.description_names_sql()})")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# --------------------------------------------------------------------------- text functions

def mask_sql(x: str) -> str:
    v = cell(x)
    return (f"(CASE WHEN {v} = '' THEN '' WHEN length({v}) <= 8 THEN '***' "
            f"WHEN starts_with({v}, 'sk-') THEN (CASE WHEN length({v}) > 10 THEN left({v}, 6) || '***' || right({v}, 4) "
            f"ELSE 'sk-***' END) WHEN length({v}) > 4 THEN left({v}, 2) || '***' || right({v}, 2) ELSE '***' END)")


def url_sql(x: str) -> str:
    v = f"regexp_replace({cell(x)}, '/+$', '')"
    return (f"(CASE WHEN {cell(x)} = '' THEN '(未配置)' WHEN regexp_matches({v}, '^https?://') "
            f"THEN regexp_extract({v}, '^(https?://)', 1) || regexp_extract({v}, '^https?://([^/?]*)', 1) "
            f"ELSE '(无效)' END)")


def ellipsize_sql(x: str, n: int) -> str:
    return f"(CASE WHEN length({x}) > {n} THEN substring({x}, 1, {n}) || '...' ELSE {x} END)"


def to_int0_sql(x: str) -> str:
    return f"coalesce(TRY_CAST(trunc(TRY_CAST({strip(x)} AS DOUBLE)) AS BIGINT), 0)"


SQL: dict[str, str] = {}

SQL["strip_text"] = (f"SELECT doc_id, {strip('text')} AS stripped, length({strip('text')})::BIGINT AS n, "
                     f"{cell('source')} AS source FROM documents")

_KW_CELL = ("('　' || p_name || ' ，' || p_brand || '、 ' || p_type || ',,' || "
            "CASE WHEN p_size > 25 THEN ' 、' ELSE '' END)")
SQL["split_keywords"] = (f"SELECT p_partkey, array_to_string({kw_list(_KW_CELL)}, '|') AS keywords, "
                         f"len({kw_list(_KW_CELL)})::BIGINT AS n FROM part")

SQL["cell_values"] = (
    f"SELECT l_orderkey, l_linenumber, {to_int0_sql(chr(39) + ' ' + chr(39) + ' || CAST(l_quantity AS VARCHAR) || ' + chr(39) + ' ' + chr(39))} AS qty_int, "
    f"{to_int0_sql('l_returnflag')} AS flag_int, 0::BIGINT AS null_int, "
    f"{to_int0_sql(chr(39) + '-' + chr(39) + ' || CAST(l_discount AS VARCHAR)')} AS neg_int, "
    f"array_to_string(list_filter(list_transform([l_returnflag, ' ', l_linestatus, NULL::VARCHAR], lambda k: coalesce({strip('k')}, '')), lambda k: k <> ''), '|') AS flags, "
    f"{cell('CAST(l_tax AS VARCHAR)')} AS tax_text, 0::BIGINT AS suffix_int, (1000 + l_linenumber)::BIGINT AS under_int, "
    f"l_linenumber::BIGINT AS wide_int, 0::BIGINT AS hex_int FROM lineitem")

SQL["mask_secret"] = (
    f"SELECT c_custkey, {mask_sql('c_name')} AS m_name, {mask_sql(chr(39) + 'sk-' + chr(39) + ' || CAST(c_custkey AS VARCHAR)')} AS m_short, "
    f"{mask_sql(chr(39) + 'sk-' + chr(39) + ' || lpad(CAST(c_custkey AS VARCHAR), 10, ' + chr(39) + '0' + chr(39) + ')')} AS m_long, "
    f"{mask_sql(chr(39) + ' ' + chr(39) + ' || substring(c_mktsegment, 1, 6) || ' + chr(39) + ' ' + chr(39))} AS m_seg, "
    f"'' AS m_null FROM customer")

SQL["url_origin"] = (
    f"SELECT page_id, {url_sql('url')} AS origin, {url_sql(chr(39) + '  ' + chr(39) + ' || url || ' + chr(39) + '//' + chr(39))} AS origin_padded, "
    f"{url_sql('regexp_replace(url, ' + chr(39) + '^https?://' + chr(39) + ', ' + chr(39) + 'ftp://' + chr(39) + ')')} AS origin_other, "
    f"{url_sql(chr(39) + chr(39))} AS origin_blank FROM pages")

SQL["ellipsize"] = (f"SELECT doc_id, {ellipsize_sql(strip('text'), 80)} AS s80, {ellipsize_sql(strip('text'), 50)} AS item, "
                    f"{ellipsize_sql(strip('text'), 120)} AS s120 FROM documents")


# --------------------------------------------------------------------------- rules

def _lit_arr(xs) -> str:
    return "[" + ", ".join(s(x) for x in xs) + "]::VARCHAR[]"


_rp = []
for _i, _g1, _g2, _g5, _no in fx.RULE_FIXTURE:
    _cols = {"g1": _lit_arr(_g1), "g2": _lit_arr(_g2), "g3": _lit_arr([]), "g4": _lit_arr([]), "g5": _lit_arr(_g5),
             "must_not": _lit_arr(_no)}
    _rp.append(f"{pred(strip('lead_name'), cols=_cols)} AS r{_i}")
SQL["rule_predicate"] = with_(PART_LEADS) + f"SELECT lead_idx, {', '.join(_rp)} FROM pleads"

_RULE_JOIN = (f"SELECT l.lead_idx, r.rule_idx, r.level1, r.code, r.atomic FROM {{leads}} l JOIN rules r "
              f"ON {pred(strip('l.lead_name'), 'r.')}")
SQL["rule_join"] = with_(RULES, PART_LEADS) + _RULE_JOIN.format(leads="pleads")
SQL["rule_join_docs"] = with_(RULES, DOC_LEADS) + _RULE_JOIN.format(leads="dleads")
SQL["rule_join_anchor"] = SQL["rule_join_docs"]
SQL["rule_unmatched"] = (with_(RULES, PART_LEADS, f"hits AS ({_RULE_JOIN.format(leads='pleads')})",
                               f"c AS ({collapse('hits', 'lead_idx')})")
                         + "SELECT l.lead_idx, coalesce(c.level1, '') AS level1, coalesce(c.code, '') AS code, "
                           "coalesce(c.atomic, '') AS atomic, coalesce(c.n_rules, 0)::BIGINT AS n_rules "
                           "FROM pleads l LEFT JOIN c USING (lead_idx)")
SQL["rule_collapse"] = (with_(RULES, DOC_LEADS, f"hits AS ({_RULE_JOIN.format(leads='dleads')})")
                        + collapse("hits", "lead_idx"))


# --------------------------------------------------------------------------- loaders

def _raw_sheet() -> str:
    head = ", ".join(f"({i}::BIGINT, {_lit_arr(r)})" for i, r in enumerate(RULE_SHEET_HEADER))
    w1, w2 = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
    cells = (f"[' ' || p_type || '　', CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END, p_name, "
             f"CAST(p_size AS VARCHAR) || '.9', {w1} || '，' || {w2}, {w2}, NULL::VARCHAR, ' ', p_brand || '、' || {w1}, "
             f"CASE WHEN p_retailprice > 1500 THEN 'old,x' ELSE '' END]")
    return (f"raw AS (SELECT * FROM (VALUES {head}) h(row_idx, cells) UNION ALL "
            f"SELECT p_partkey + 2 AS row_idx, list_slice({cells}, 1, 3 + p_size % 8) || CASE WHEN p_size % 8 = 7 "
            f"THEN [p_type FOR x IN range(p_partkey % 7)] ELSE []::VARCHAR[] END AS cells FROM part)")


RAW = _raw_sheet()
PARSED = ("parsed AS (SELECT row_idx - 2 AS rule_idx, " + cell("cells[1]") + " AS level1, coalesce(cells[2], '') AS code, "
          + cell("cells[3]") + " AS atomic, " + to_int0_sql("cells[4]") + " AS sequence_no, "
          + ", ".join(f"{kw_list(f'cells[{5 + i}]')} AS g{i + 1}" for i in range(4)) + ", "
          + f"{kw_list('cells[9]')} AS g5, {kw_list('cells[10]')} AS must_not FROM raw WHERE row_idx >= 2)")
SQL["rules_parse"] = (with_(RAW, PARSED) + "SELECT rule_idx, level1, code, atomic, sequence_no, "
                      + ", ".join(f"array_to_string({g}, '|') AS {g}" for g in ("g1", "g2", "g3", "g4", "g5", "must_not"))
                      + " FROM parsed")
SQL["rule_meta"] = (with_(RAW,
                          "w AS (SELECT max(len(cells)) AS w FROM raw)",
                          "cols AS (SELECT unnest(range(0, w)) AS col_idx FROM w)",
                          "head AS (SELECT row_idx, unnest(range(0, len(cells))) AS col_idx, unnest(cells) AS v FROM raw WHERE row_idx < 2)")
                    + f"SELECT c.col_idx::INTEGER AS col_idx, coalesce(max(CASE WHEN h.row_idx = 0 THEN {cell('h.v')} END), '') AS logic, "
                      f"coalesce(max(CASE WHEN h.row_idx = 1 THEN {cell('h.v')} END), '') AS field "
                      f"FROM cols c LEFT JOIN head h USING (col_idx) GROUP BY c.col_idx")
SQL["brands_parse"] = (with_(NAMED, BRANDS,
                             "raw AS (SELECT brand_idx AS row_idx, CASE WHEN brand_idx % 9 = 0 THEN NULL ELSE brand_code END AS code, "
                             "CASE WHEN brand_idx % 11 = 0 THEN '  ' ELSE ' ' || brand_name END AS name, 'a，b' AS kw, atomic FROM brands)")
                       + f"SELECT row_idx AS brand_idx, coalesce(code, '') AS brand_code, {cell('name')} AS brand_name, "
                         f"{cell('kw')} AS brand_keywords, {cell('atomic')} AS atomic FROM raw WHERE {cell('name')} <> ''")
_LEAD_NAME = "CASE WHEN p_size = 1 THEN '　' ELSE p_name END"
SQL["leads_parse"] = (f"SELECT p_partkey AS lead_idx, {cell(chr(39) + ' P' + chr(39) + ' || CAST(p_partkey AS VARCHAR)')} AS lead_code, "
                      f"{cell(_LEAD_NAME)} AS lead_name FROM part WHERE {cell(_LEAD_NAME)} <> ''")


def _top_words(rules_rel: str, n: int) -> str:
    return (f"words AS (SELECT rule_idx, unnest(range(0, len(w))) AS p, unnest(w) AS kw FROM "
            f"(SELECT rule_idx, [atomic] || g1 || g2 || g3 || g4 || g5 AS w FROM {rules_rel})), "
            f"cleaned AS (SELECT rule_idx, p, {strip('kw')} AS keyword FROM words WHERE {strip('kw')} <> ''), "
            f"firsts AS (SELECT keyword, rule_idx, p FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY rule_idx, p) AS rn "
            f"FROM cleaned) WHERE rn = 1), "
            f"top AS (SELECT keyword, rule_idx, p::BIGINT AS p FROM firsts ORDER BY rule_idx, p LIMIT {n})")


def _hint(max_chars: int) -> str:
    f = "f"
    cut = f"left({f}, {max_chars})"
    return (f"hintfull AS (SELECT coalesce(string_agg(keyword, '、' ORDER BY rule_idx, p), '') AS f FROM top), "
            f"hint AS (SELECT CASE WHEN length(f) <= {max_chars} THEN f WHEN strpos({cut}, '、') > 0 "
            f"THEN regexp_replace({cut}, '、[^、]*$', '') ELSE {cut} END AS hint FROM hintfull)")


SQL["keyword_top_n"] = with_(RAW, PARSED, _top_words("parsed", P.max_keyword_examples)) + "SELECT * FROM top"
SQL["keyword_hint"] = with_(RAW, PARSED, _top_words("parsed", P.max_keyword_examples), _hint(40)) + "SELECT hint FROM hint"
SQL["category_nodes"] = (
    f"SELECT {cell(chr(39) + ' ' + chr(39) + ' || CAST(r_regionkey AS VARCHAR)')} AS id, {cell(chr(39) + chr(39) + ' || r_name || ' + chr(39) + '　' + chr(39))} AS name, "
    f"1 AS level, '' AS parent_id, true AS valid FROM region UNION ALL "
    f"SELECT {cell('CAST(n_nationkey AS VARCHAR)')}, {cell('n_name')}, (2 - CASE WHEN n_nationkey = 24 THEN 3 ELSE 0 END)::INTEGER, "
    f"{cell('CAST(n_regionkey AS VARCHAR)')}, (2 - CASE WHEN n_nationkey = 24 THEN 3 ELSE 0 END) >= 0 FROM nation")


# --------------------------------------------------------------------------- similarity

PAIRS = ("pairs AS (SELECT l.lead_idx, b.brand_idx, l.lead_name, b.brand_name, l.embedding AS lv, b.embedding AS bv "
         "FROM vleads l JOIN brands b ON b.brand_idx = l.lead_idx + 1 - l.lead_idx % 2)")
_SIM = with_(NAMED, BRANDS, VLEADS, PAIRS)
SQL["jaro_winkler_pairs"] = (_SIM + f"SELECT lead_idx, brand_idx, round(jaro_winkler_similarity({strip('lead_name')}, {strip('brand_name')}), 6) AS jw, "
                             f"round(jaro_winkler_similarity({strip('lower(lead_name)')}, {strip('reverse(brand_name)')}), 6) AS jw_other FROM pairs")
_COS = "list_dot_product(lv::DOUBLE[], bv::DOUBLE[])"
SQL["cosine_pairs"] = _SIM + f"SELECT lead_idx, brand_idx, round({_COS}, 6) AS cos, round(({_COS} + 1.0) / 2.0, 6) AS cos01 FROM pairs"
SQL["combined_pairs"] = (_SIM + f"SELECT lead_idx, brand_idx, round({score_sql('lv', 'bv', 'lead_name', 'brand_name')}, 6) AS combined, "
                         f"round({score_sql('lv', 'bv', 'lead_name', 'brand_name', 0.7)}, 6) AS combined_w07 FROM pairs")


def _top1(texts: str, key: str, tv: str, tt: str, combined: bool = True) -> str:
    return (f"scored AS (SELECT {key}, b.brand_idx, b.brand_name, b.brand_code, b.atomic AS brand_atomic, "
            f"{score_sql(tv, 'b.embedding', tt, 'b.brand_name', P.vector_weight, combined)} AS score "
            f"FROM {texts}, brands b WHERE {strip('b.brand_name')} <> ''), "
            f"best AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {key.split('.')[-1].split(' AS ')[-1]} "
            f"ORDER BY score DESC, brand_idx) AS rn FROM scored) WHERE rn = 1)")


_V_TOP = with_(NAMED, BRANDS, VLEADS, _top1("vleads l", "l.lead_idx", "l.embedding", "l.lead_name"))
SQL["sim_top1"] = _V_TOP + "SELECT lead_idx, brand_idx, round(score, 6) AS score, printf('%.4f', score) AS score_text FROM best"
SQL["sim_top1_grid"] = SQL["sim_top1"]
SQL["sim_top1_vector_only"] = (with_(NAMED, BRANDS, VLEADS, _top1("vleads l", "l.lead_idx", "l.embedding", "l.lead_name", False))
                               + "SELECT lead_idx, brand_idx, round(score, 6) AS score, printf('%.4f', score) AS score_text FROM best")
SQL["sim_top1_names"] = (with_(NAMED, BRANDS, PART_LEADS, f"names AS (SELECT DISTINCT {strip('lead_name')} AS text, NULL::FLOAT[] AS v FROM pleads)",
                               _top1("names n", "n.text", "n.v", "n.text"))
                         + "SELECT text, brand_idx, round(score, 6) AS score, printf('%.4f', score) AS score_text FROM best")
SQL["sim_match"] = (_V_TOP + "SELECT lead_idx, CASE WHEN score >= 0.75 THEN brand_idx END AS brand_idx, "
                    "CASE WHEN score >= 0.75 THEN brand_name END AS brand_name, CASE WHEN score >= 0.75 THEN brand_code END AS brand_code, "
                    "CASE WHEN score >= 0.75 THEN brand_atomic END AS brand_atomic, CASE WHEN score >= 0.75 THEN round(score, 6) END AS score FROM best")


# --------------------------------------------------------------------------- cascade

def cascade_ctes(leads: str, descs: str | None, with_brands: bool = True) -> list[str]:
    """CTEs ending in ``labelled(t, m_n, ..., method)``; ``leads`` has lead_name and embedding."""
    ctes = [
        f"names AS (SELECT DISTINCT {strip('lead_name')} AS t, embedding AS v FROM {leads})",
        f"r1 AS (SELECT n.t, r.rule_idx, r.level1, r.code, r.atomic FROM names n JOIN rules r ON {pred('n.t', 'r.')})",
        f"c1 AS ({collapse('r1', 't')})",
        "rest0 AS (SELECT n.t, n.v FROM names n ANTI JOIN c1 USING (t))",
    ]
    nulls = "NULL::BIGINT AS ref_idx, NULL::VARCHAR AS ref_name, NULL::VARCHAR AS ref_code, NULL::VARCHAR AS ref_atomic, NULL::DOUBLE AS score, NULL::VARCHAR AS score_text"
    branches = [f"SELECT t, n_rules AS m_n, level1 AS m_level1, code AS m_code, atomic AS m_atomic, false AS from_sim, {nulls}, NULL::VARCHAR AS llm_desc, false AS is_err FROM c1"]
    if not with_brands:
        ctes.append("rest AS (SELECT * FROM rest0)")
        branches.append(f"SELECT t, 0, '', '', '', false, {nulls}, NULL, false FROM rest")
    else:
        ctes += [
            # a vector whose length differs from the brands' cannot be scored: error row
            (f"erred AS (SELECT t FROM rest0 WHERE v IS NOT NULL AND len(v) <> "
             f"(SELECT max(len(embedding)) FROM brands WHERE {strip('brand_name')} <> ''))"),
            "rest AS (SELECT * FROM rest0 ANTI JOIN erred USING (t))",
            _top1("rest", "rest.t", "rest.v", "rest.t"),
            f"sim AS (SELECT *, printf('%.4f', score) AS score_text FROM best WHERE score >= {float(P.similarity_threshold)!r})",
            (f"low AS (SELECT s.*, nullif({strip('d.description')}, '') AS description FROM sim s LEFT JOIN {descs} d ON d.text = s.t "
             f"WHERE s.score < {float(P.fallback_threshold)!r})"),
            f"other AS (SELECT * FROM low WHERE description IS NOT NULL AND description NOT IN ({alias_list()}))",
            f"r2 AS (SELECT o.t, r.rule_idx, r.level1, r.code, r.atomic FROM other o JOIN rules r ON {pred('o.description', 'r.')})",
            f"c2 AS ({collapse('r2', 't')})",
        ]
        simc = f"true, brand_idx, brand_name, brand_code, brand_atomic, score, score_text"
        brand_rule = f"1, '', '', coalesce({strip('brand_atomic')}, '')"
        branches += [
            f"SELECT t, 0, '', '', '', false, {nulls}, NULL, true FROM erred",
            f"SELECT t, 0, '', '', '', false, {nulls}, NULL, false FROM rest ANTI JOIN sim USING (t)",
            f"SELECT t, {brand_rule}, {simc}, NULL, false FROM sim WHERE score >= {float(P.fallback_threshold)!r}",
            f"SELECT t, {brand_rule}, {simc}, {s(EMPTY_DESCRIPTION)}, false FROM low WHERE description IS NULL",
            f"SELECT t, {brand_rule}, {simc}, {s(P.unmatched_marker)}, false FROM low WHERE description IN ({alias_list()})",
            (f"SELECT o.t, c2.n_rules, c2.level1, c2.code, c2.atomic, false, {nulls}, o.description, false "
             f"FROM other o JOIN c2 USING (t)"),
            f"SELECT t, {brand_rule}, {simc}, description, false FROM other ANTI JOIN c2 USING (t)",
        ]
    ctes.append("per_text AS (" + " UNION ALL ".join(branches) + ")")
    desc = "coalesce(llm_desc, '')"
    method = (f"CASE WHEN is_err THEN {s(METHOD_ERROR)} WHEN m_n = 0 THEN {s(METHOD_NONE)} "
              f"WHEN {desc} = '' THEN (CASE WHEN from_sim THEN {s(METHOD_SIMILARITY)} ELSE {s(METHOD_RULE)} END) "
              f"WHEN {strip(desc)} IN ({alias_list()}) THEN {s(METHOD_NOT_FOUND)} "
              f"WHEN NOT from_sim THEN {s(METHOD_SEARCH_MATCHED)} ELSE {s(METHOD_SEARCH_UNMATCHED)} END")
    ctes.append(f"labelled AS (SELECT *, {method} AS method FROM per_text)")
    return ctes


def result_select(leads: str) -> str:
    blank = f"(p.method IN ({s(METHOD_NOT_FOUND)}, {s(METHOD_SEARCH_UNMATCHED)}) OR p.m_n = 0)"
    ref = "(p.ref_idx IS NOT NULL AND p.m_n > 0)"
    return (f"SELECT l.lead_idx, l.lead_code, l.lead_name, "
            f"CASE WHEN {blank} THEN '' ELSE p.m_level1 END AS level1, CASE WHEN {blank} THEN '' ELSE p.m_code END AS code, "
            f"CASE WHEN {blank} THEN '' ELSE p.m_atomic END AS atomic, p.method, "
            f"CASE WHEN {ref} THEN {cell('p.ref_name')} ELSE '' END AS sim_brand, "
            f"CASE WHEN {ref} THEN coalesce(p.ref_code, '') ELSE '' END AS sim_code, "
            f"CASE WHEN {ref} THEN {cell('p.ref_atomic')} ELSE '' END AS sim_atomic, "
            f"CASE WHEN {ref} AND p.from_sim THEN coalesce(p.score_text, '') ELSE '' END AS sim_score, "
            f"CASE WHEN p.is_err THEN {s(METHOD_ERROR)} ELSE coalesce(p.llm_desc, '') END AS llm_desc, "
            f"round(CASE WHEN p.from_sim AND p.m_n > 0 THEN p.score END, 6) AS score "
            f"FROM {leads} l JOIN labelled p ON p.t = {strip('l.lead_name')}")


_PART_CASCADE = with_(RULES, NAMED, BRANDS, PART_LEADS, PDESC, *cascade_ctes("pleads", "pdesc"))
_VEC_CASCADE = with_(RULES, NAMED, BRANDS, VLEADS, VDESC, *cascade_ctes("vleads", "vdesc"))
BLEADS = ("bleads AS (SELECT lead_idx, lead_code, lead_name, CASE WHEN label = 9 THEN "
          "list_slice(embedding, 1, len(embedding) - 1) ELSE embedding END AS embedding FROM vleads)")
_BAD_CASCADE = with_(RULES, NAMED, BRANDS, VLEADS, VDESC, BLEADS, *cascade_ctes("bleads", "vdesc"))
_RESULT = "lead_idx, lead_code, lead_name, level1, code, atomic, method, sim_brand, sim_code, sim_atomic, sim_score, llm_desc"
SQL["cascade_full"] = _PART_CASCADE + result_select("pleads")
SQL["cascade_vectors"] = _VEC_CASCADE + result_select("vleads")
SQL["error_rows"] = _BAD_CASCADE + result_select("bleads")
SQL["result_rows"] = f"SELECT {_RESULT} FROM ({SQL['cascade_vectors']})"
SQL["method_label"] = f"SELECT lead_idx, method FROM ({SQL['cascade_full']})"
SQL["reattach_duplicates"] = (f"SELECT {_RESULT} FROM (" + with_(RULES, PART_LEADS, *cascade_ctes("pleads", None, False))
                              + result_select("pleads") + ")")
SQL["per_text"] = (_PART_CASCADE + "SELECT t AS text, m_n, m_atomic, from_sim, ref_idx AS brand_idx, round(score, 6) AS score, "
                   "llm_desc FROM labelled")
SQL["describe_join"] = (with_(PDESC) + f"SELECT n.text, nullif({strip('d.description')}, '') AS description FROM "
                        f"(SELECT DISTINCT p_name AS text FROM part) n LEFT JOIN pdesc d ON d.text = n.text")
SQL["describe_rematch"] = (with_(RULES, PDESC, f"d AS ({SQL['describe_join'][len(with_(PDESC)):]})",
                                 f"o AS (SELECT * FROM d WHERE description IS NOT NULL AND description NOT IN ({alias_list()}))",
                                 f"hits AS (SELECT o.text, o.description, r.rule_idx, r.level1, r.code, r.atomic FROM o JOIN rules r "
                                 f"ON {pred('o.description', 'r.')})",
                                 f"c AS ({collapse('hits', 'text, description')})")
                           + "SELECT o.text, o.description, coalesce(c.level1, '') AS level1, coalesce(c.code, '') AS code, "
                             "coalesce(c.atomic, '') AS atomic, coalesce(c.n_rules, 0)::BIGINT AS n_rules "
                             "FROM o LEFT JOIN c USING (text, description)")
SQL["fallback_requests"] = (
    with_(RULES, NAMED, BRANDS, VLEADS, *cascade_ctes("vleads", "vdesc")[:7],
          _top_words("rules", P.max_keyword_examples), _hint(P.max_keyword_hint_chars),
          f"sim AS (SELECT *, printf('%.4f', score) AS score_text FROM best WHERE score >= {float(P.similarity_threshold)!r})")
    + f"SELECT s.t AS text, h.hint AS reference_keywords, {float(P.fallback_threshold)!r}::DOUBLE AS similarity_threshold, "
      f"CAST(s.score_text AS DOUBLE) AS similarity_score, {ellipsize_sql('s.t', 50)} AS item "
      f"FROM sim s, hint h WHERE s.score < {float(P.fallback_threshold)!r}")


# --------------------------------------------------------------------------- reports

_SUCC = ", ".join(s(m) for m in SUCCESS_METHODS)
SQL["match_counts"] = (f"SELECT count(*) FILTER (WHERE method IN ({_SUCC}))::BIGINT AS n_success, "
                       f"count(*) FILTER (WHERE method NOT IN ({_SUCC}))::BIGINT AS n_failed, count(*)::BIGINT AS n_total "
                       f"FROM ({SQL['cascade_full']})")
_SHEET_LEADS = f"pleads AS (SELECT lead_idx, lead_code, lead_name, NULL::FLOAT[] AS embedding FROM ({SQL['leads_parse']}))"
SQL["chunk_progress"] = (f"SELECT chunk, n_rows, n_success, sum(n_rows) OVER (ORDER BY chunk)::BIGINT AS processed, "
                         f"sum(n_rows) OVER ()::BIGINT AS total, round(100.0 * sum(n_rows) OVER (ORDER BY chunk) / sum(n_rows) OVER (), 1) AS percent "
                         f"FROM (SELECT floor(pos / 500)::BIGINT AS chunk, count(*)::BIGINT AS n_rows, "
                         f"count(*) FILTER (WHERE method IN ({_SUCC}))::BIGINT AS n_success FROM "
                         f"(SELECT *, row_number() OVER (ORDER BY lead_idx) - 1 AS pos FROM ("
                         + with_(RULES, NAMED, BRANDS, _SHEET_LEADS, PDESC, *cascade_ctes("pleads", "pdesc")) + result_select("pleads") + ")) GROUP BY 1)")
SQL["nested_view"] = (f"SELECT lead_idx, lead_code AS \"线索编码\", lead_name AS \"输入品类\", level1 AS \"一级原子品类\", code AS \"品类编码\", "
                      f"atomic AS \"原子品类\", method AS \"匹配方式\", sim_brand AS \"相似度匹配结果/品牌\", sim_code AS \"相似度匹配结果/编码\", "
                      f"sim_atomic AS \"相似度匹配结果/原子品类\", sim_score AS \"相似度匹配结果/相似度\", llm_desc AS \"大模型描述\" "
                      f"FROM ({SQL['cascade_vectors']})")
SQL["flag_failed"] = f"SELECT lead_idx, method, method NOT IN ({_SUCC}) AS is_failed FROM ({SQL['cascade_full']})"
SQL["compact_rows"] = (f"SELECT lead_idx, {cell('lead_name')} AS raw_text, {cell('level1')} AS level1, {cell('code')} AS code, "
                       f"{cell('atomic')} AS atomic, {cell('method')} AS method, {cell('sim_brand')} AS similarity_detail, "
                       f"{cell('llm_desc')} AS llm_desc FROM ({SQL['cascade_vectors']})")


LLEADS = (f"lleads AS (SELECT l.l_orderkey * 8 + l.l_linenumber AS lead_idx, "
          f"CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS lead_code, "
          f"CASE WHEN l.l_linenumber = 1 THEN {s(fx.HOT_NAME)} ELSE coalesce(p.p_name, '') END AS lead_name, "
          f"NULL::FLOAT[] AS embedding FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey)")
SQL["cascade_lineitem"] = (f"SELECT lead_idx, lead_code, method, atomic, sim_brand, sim_score, llm_desc FROM ("
                           + with_(RULES, NAMED, BRANDS, LLEADS, PDESC, *cascade_ctes("lleads", "pdesc"))
                           + result_select("lleads") + ")")
SQL["rule_join_sheet"] = (with_(RAW, PARSED, DOC_LEADS)
                          + f"SELECT l.lead_idx, r.rule_idx, r.atomic FROM dleads l JOIN parsed r ON {pred(strip('l.lead_name'), 'r.')}")

SQL["output_names"] = ("SELECT stem, CASE WHEN coalesce(stem, '') = '' OR stem = 'src3' THEN '匹配结果_20260101_000000' "
                       "ELSE stem || '_匹配结果_20260101_000000' END AS output_name "
                       "FROM (SELECT DISTINCT source AS stem FROM documents)")
SQL["table_counts"] = (
    "SELECT 'rules' AS \"table\", count(*)::BIGINT AS n FROM (" + with_(RAW, PARSED) + "SELECT * FROM parsed) UNION ALL "
    "SELECT 'brands', count(*)::BIGINT FROM (" + SQL["brands_parse"] + ") UNION ALL "
    "SELECT 'leads', count(*)::BIGINT FROM (" + SQL["leads_parse"] + ")")
SQL["workbook_roundtrip"] = (f"SELECT 'leads-' || (p_partkey % 4) AS file, row_number() OVER (ORDER BY p_partkey % 4, p_partkey) - 1 AS lead_idx, "
                             f"CAST(p_partkey AS VARCHAR) AS lead_code, {cell('p_name')} AS lead_name FROM part WHERE {cell('p_name')} <> ''")
SQL["workbook_dates"] = "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d 00:00:00') AS shown FROM orders"
SQL["results_sink"] = f"SELECT {_RESULT} FROM ({SQL['cascade_full']})"
SQL["encode_join"] = ("SELECT p_partkey AS lead_idx, 64::BIGINT AS dim, "
                      "CASE WHEN p_name = '' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS norm FROM part")
SQL["rule_collapse_sheet"] = (with_(RAW, PARSED, DOC_LEADS,
                                   f"hits AS (SELECT l.lead_idx, r.rule_idx, r.level1, r.code, r.atomic FROM dleads l "
                                   f"JOIN parsed r ON {pred(strip('l.lead_name'), 'r.')})")
                             + collapse("hits", "lead_idx"))

_LIT_RULES = ", ".join(f"({i}::BIGINT, {s(l1)}, {s(code)}, {s(atomic)}, {_lit_arr(g1)}, {_lit_arr([])}, {_lit_arr([])}, {_lit_arr([])}, {_lit_arr(g5)}, {_lit_arr(no)})"
                       for i, (l1, code, atomic, g1, g5, no) in enumerate(fx.LITERAL_RULES))
_TAILS = "[" + ", ".join(s(t) for t in fx.LITERAL_TAILS) + "]"
SQL["rule_join_literal"] = (with_(f"rules AS (SELECT * FROM (VALUES {_LIT_RULES}) r(rule_idx, level1, code, atomic, g1, g2, g3, g4, g5, must_not))",
                                  f"pleads AS (SELECT p_partkey AS lead_idx, p_name || {_TAILS}[p_partkey % {len(fx.LITERAL_TAILS)} + 1] AS lead_name FROM part)")
                            + _RULE_JOIN.format(leads="pleads"))
_WORDS = "list_filter(string_split(regexp_replace(text, '[^A-Za-z ]+', ' ', 'g'), ' '), lambda w: w <> '')"
SQL["rule_join_words"] = (with_(f"bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark)",
                                "rules AS (SELECT item_id AS rule_idx, 'item ' || CAST(item_id AS VARCHAR) AS atomic, list_slice(w, 1, 2) AS g1, "
                                + ", ".join(f"[]::VARCHAR[] AS {g}" for g in ("g2", "g3", "g4", "must_not")) + ", list_slice(w, 3, 1002) AS g5 FROM bw)", DOC_LEADS)
                          + f"SELECT l.lead_idx, r.rule_idx, r.atomic FROM dleads l JOIN rules r ON {pred(strip('l.lead_name'), 'r.')}")
SQL["rule_join_grams"] = SQL["rule_join_words"].replace("FROM dleads l", "FROM (FROM dleads UNION ALL FROM dleads) l")
_SHEET_RULES = "rules AS (SELECT * FROM parsed)"
SQL["cascade_sheet"] = with_(RAW, PARSED, _SHEET_RULES, NAMED, BRANDS, PART_LEADS, PDESC, *cascade_ctes("pleads", "pdesc")) + result_select("pleads")
ASCII_LEADS = ("aleads AS (SELECT doc_id AS lead_idx, CAST(doc_id AS VARCHAR) AS lead_code, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS lead_name, "
               "NULL::FLOAT[] AS embedding FROM documents)")
SQL["cascade_documents"] = (f"SELECT lead_idx, atomic, method, sim_brand, score FROM ("
                            + with_(RULES, NAMED, BRANDS, ASCII_LEADS, PDESC, *cascade_ctes("aleads", "pdesc")) + result_select("aleads") + ")")
SQL["append_sink"] = f"SELECT {_RESULT} FROM ({SQL['cascade_full']})"
SQL["committed_append"] = SQL["append_sink"]
SQL["compact_records"] = SQL["compact_rows"]
SQL["l2_normalize"] = ("SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6)) AS v "
                       "FROM embeddings")
