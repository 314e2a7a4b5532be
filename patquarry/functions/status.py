"""Legal status and kind of patent as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ALIVE, DEAD, PENDING, UNKNOWN = "alive", "dead", "pending", "unknown"
#: Source wording to state (fixed values).
STATES = {
    ALIVE: ("授权", "授權", "已核准", "registered", "granted", "grant", "active"),
    PENDING: ("审查中", "申请", "公开", "即将授权", "即將授權", "審查中", "申請", "已申請", "公開", "已公開", "pending", "published", "application", "under examination"),
    DEAD: ("到期", "放弃", "撤回", "拒绝", "删除", "无效", "放棄", "核駁", "拒絕", "刪除", "無效", "已失效", "屆滿失效", "expired", "withdrawn", "abandoned", "lapsed", "rejected", "revoked", "ceased", "deleted"),
}
#: Report buckets in the order of reports (fixed values).
BUCKETS = {ALIVE: "已授權", PENDING: "審查中", DEAD: "已失效", UNKNOWN: "未知"}
#: Terms that may be registered by hand, and how other wording is shown (fixed values).
ALLOWED = ("申請", "公開", "審查中", "即將授權", "授權", "放棄", "撤回", "拒絕", "刪除", "到期")
SHOWN = {
    "授权": "授權", "审查中": "審查中", "申请": "申請", "公开": "公開", "放弃": "放棄", "无效": "無效", "拒绝": "拒絕", "删除": "刪除", "即将授权": "即將授權",
    "已核准": "授權", "已公開": "公開", "已申請": "申請", "核駁": "拒絕", "已失效": "無效", "屆滿失效": "到期",
}
DESIGN_KINDS = ("S", "S1")
#: Kinds as reports name them (fixed values).
DESIGN, UTILITY, INVENTION, UNMARKED = "設計", "新型", "發明", "未標示"


def _lookup(key: Column) -> Column:
    out = F
    for state, words in STATES.items():
        out = out.when(key.isin(*words), F.lit(state))
    return out


#: A note in brackets at the end of a status (a fixed pattern).
NOTE = r"\s*[(（].*[)）]\s*$"


def normalize(status: Column) -> Column:
    """alive, dead, pending or unknown: the whole value first, then without a bracket at its end."""
    text = F.trim(status)
    bare = F.trim(F.regexp_replace(text, NOTE, ""))
    return F.coalesce(_lookup(F.lower(text)), _lookup(F.lower(bare)), F.lit(UNKNOWN))


def bucket(status: Column) -> Column:
    state = normalize(status)
    out = F
    for k, v in BUCKETS.items():
        out = out.when(state == k, F.lit(v))
    return out


def display(status: Column) -> Column:
    text = F.trim(status)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SHOWN.items() for x in kv])[text], status)


def display_term(status: Column) -> Column:
    """The column of a cross table: unknown if blank, every expiry as one, unseen wording as it is."""
    term = F.trim(display(status))
    return F.when(F.coalesce(term, F.lit("")) == "", F.lit("未知")).when(term.startswith("到期"), F.lit("到期")).otherwise(term)


def validate_registered(status: Column) -> Column:
    """The trimmed term; raises for one that may not be registered."""
    text = F.trim(F.coalesce(status, F.lit("")))
    return F.when(text.isin(*ALLOWED), text).otherwise(F.raise_error(F.concat(F.lit("unsupported status: "), text)))


def normalize_registered(status: Column) -> Column:
    text = F.trim(status)
    return F.when(text.isin(*ALLOWED), normalize(text)).otherwise(F.lit(UNKNOWN))


def is_design(document_kind: Column) -> Column:
    return F.upper(F.trim(F.coalesce(document_kind, F.lit("")))).isin(*DESIGN_KINDS)


def patent_kind(document_kind: Column, patent_type: Column) -> Column:
    kind = F.upper(F.trim(patent_type))
    return F.when(is_design(document_kind), F.lit(DESIGN)).when(kind == "U", F.lit(UTILITY)).when(kind == "P", F.lit(INVENTION)).otherwise(F.lit(UNMARKED))
