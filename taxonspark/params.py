"""Run parameters and the fixed output vocabulary.

Everything a run can tune lives in the frozen ``Params`` dataclass that is passed
explicitly to the operators; there is no global configuration object.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# These strings appear in the output and must stay exactly as is.
# ---------------------------------------------------------------------------
METHOD_RULE = "规则"
METHOD_SIMILARITY = "相似度"
METHOD_SEARCH_MATCHED = "搜索后匹配"
METHOD_NONE = "未匹配"
METHOD_NOT_FOUND = "未搜索到"
METHOD_SEARCH_UNMATCHED = "搜索后未匹配"
METHOD_ERROR = "程序异常"
SUCCESS_METHODS = ("规则", "相似度", "搜索后匹配")
EMPTY_DESCRIPTION = "大模型无有效返回（无内容且无 tool_calls）"
DEFAULT_UNMATCHED_MARKER = "未匹配到结果"
DEFAULT_UNMATCHED_ALIASES = ("未匹配到结果", "未匹配到")
JOIN_SEPARATOR = "；"
HINT_SEPARATOR = "、"
KEYWORD_SEPARATORS = ",，、"
RESULT_COLUMNS = (
    "lead_code", "lead_name", "level1", "code", "atomic", "method",
    "sim_brand", "sim_code", "sim_atomic", "sim_score", "llm_desc",
)
RESULT_HEADER = ("线索编码", "输入品类", "一级原子品类", "品类编码", "原子品类", "匹配方式",
                 "品牌", "编码", "原子品类", "相似度", "大模型描述")
SIMILARITY_GROUP_TITLE = "相似度匹配结果"
LLM_DESC_TITLE = "大模型描述"
RESULT_SHEET_NAME = "匹配结果"
OUTPUT_NAME_TAG = "匹配结果"
DEFAULT_INPUT_STEM_IGNORE = "新建文本文档"
BRAND_NAME_HEADER = "品牌名称"
BRAND_CODE_HEADER = "品牌编码"
BRAND_KEYWORDS_HEADER = "品牌关键词（，表示同时包含）"
BRAND_ATOMIC_HEADER = "原子品类"
LEAD_CODE_HEADER = "线索编码"
LEAD_NAME_HEADER = "线索名称"
URL_NOT_SET = "(未配置)"
URL_INVALID = "(无效)"
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Params:
    """Tunable knobs of one matching run (defaults follow the reference config)."""

    similarity_threshold: float = 0.0
    fallback_threshold: float = 0.9
    unmatched_marker: str = DEFAULT_UNMATCHED_MARKER
    unmatched_aliases: tuple[str, ...] = DEFAULT_UNMATCHED_ALIASES
    vector_weight: float = 0.5               # fixed default of the reference: 0.5 cosine / 0.5 Jaro-Winkler
    use_combined: bool = True
    max_keyword_examples: int = 10
    max_keyword_hint_chars: int = 120
    chunk_size: int = 0
    # Physical-plan knobs (not semantics).
    rule_plan: str = "auto"                 # "auto" | "literal" | "broadcast" | "anchor"
    max_broadcast_rules: int = 20_000       # rule rows (and 8 x as many keywords) allowed in a broadcast
    max_compiled_rules: int = 256           # rule rows and keywords that "auto" compiles into a projection;
    max_compiled_keywords: int = 512        # above either it uses the anchor plan (same result)
    max_broadcast_keywords: int = 500_000   # distinct keywords in one automaton; more are partitioned by q-grams
    max_broadcast_brands: int = 250_000     # brand rows allowed in the broadcast kernel
    max_broadcast_bytes: int = 256 * 1024 * 1024  # brand vector bytes (float32) in the broadcast
    brand_block_rows: int = 50_000          # brand rows per block in the grid plan
    text_block_rows: int = 20_000           # text rows per bucket in the grid plan
    text_block_bytes: int = 64 * 1024 * 1024  # text and vector bytes per bucket in the grid plan
    grid_blocks: int = 0                    # fixed brand-block count for the grid (0: from brand_block_rows)
    grid_buckets: int = 0                   # least text-bucket count for the grid (more by text_block_rows and text_block_bytes)
    kernel_batch_cells: int = 4_000_000     # text x brand score cells per numpy block
    kernel_partitions: int = 0              # tasks for the similarity kernel (0: 2 x defaultParallelism)
    provider_tasks: int = 0                 # at most this many tasks call a describer callable at once
                                            # (0: no cap; the reference runs 8 calls at a time)
    provider_batch: int = 10_000            # texts whose answers are committed together
    provider_retries: int = 0               # more tries of a call that raises, after waiting provider_wait seconds,
    provider_wait: float = 0.5              # doubled each time up to provider_max_wait
    provider_max_wait: float = 30.0
    answer_journal: str = ""                # folder of the answers; a run that names an earlier one's goes on from it

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


DEFAULT_PARAMS = Params()
