"""Types of entities, relations, questions and documents, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The types, with the codes that their order gives.
ENTITY_TYPES = ("PERSON", "ORGANIZATION", "LOCATION", "TIME", "EVENT", "CONCEPT", "PRODUCT", "RIVER", "MOUNTAIN", "UNKNOWN")
RELATION_TYPES = ("IS_A", "PART_OF", "LOCATED_IN", "BORN_IN", "WORKS_FOR", "CREATED_BY", "HAS_PROPERTY", "BELONGS_TO", "RELATED_TO", "CUSTOM", "FLOWS_THROUGH", "FRIEND_OF", "LOCATED_NEAR", "LOCATED_ON", "LOCATED_AT", "CAPITAL_OF", "UNKNOWN")
INVERSE_NAMES = {"IS_A": "是...的一种", "PART_OF": "包含", "LOCATED_IN": "位置包含", "BORN_IN": "是...的出生地", "WORKS_FOR": "雇佣", "CREATED_BY": "创建了", "HAS_PROPERTY": "是...的属性", "BELONGS_TO": "拥有", "RELATED_TO": "相关"}
SYMMETRIC_TYPES = ("RELATED_TO",)
QUERY_TYPE_LABELS = {"FACT": "事实查询", "ENTITY": "实体查询", "RELATION": "关系查询", "ATTRIBUTE": "属性查询", "LIST": "列表查询", "COMPARISON": "比较查询", "DEFINITION": "定义查询", "OPEN": "开放查询", "UNKNOWN": "未知查询"}
STRATEGY_LABELS = {"EXACT_MATCH": "精确匹配", "SEMANTIC": "语义搜索", "PATH_FINDING": "路径查找", "HYBRID": "混合策略"}
STOP_WORDS = ("的", "了", "在", "是", "我", "有", "和", "与", "这", "那", "你", "会", "要", "就", "都", "而", "及", "上", "也", "很", "但", "到", "对", "可以", "去", "把")


def mapped(key: Column, values: dict, otherwise=None) -> Column:
    """The value of a small literal table, as one CASE."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(otherwise)) if out is not None else F.lit(otherwise)


def type_code(kind: Column, types: tuple) -> Column:
    """The place of a type among ``types``; that of UNKNOWN for others and null."""
    return F.coalesce(mapped(kind, {t: i for i, t in enumerate(types)}), F.lit(len(types) - 1))


def type_name(code: Column, types: tuple) -> Column:
    return F.coalesce(mapped(code, dict(enumerate(types))), F.lit(types[-1]))


def inverse_name(kind: Column) -> Column:
    """The name of the opposite direction that a relation type has of itself; empty without one."""
    return mapped(kind, INVERSE_NAMES, "")


def is_symmetric(kind: Column) -> Column:
    return F.coalesce(kind.isin(*SYMMETRIC_TYPES), F.lit(False))


def query_type_label(kind: Column) -> Column:
    return mapped(kind, QUERY_TYPE_LABELS, "未定义查询")


def strategy_label(kind: Column) -> Column:
    return mapped(kind, STRATEGY_LABELS, "未知策略")


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double")))


def triple_id(subject: Column, relation: Column, obj: Column) -> Column:
    return F.concat_ws("_", subject, relation, obj)


def _properties(properties: Column) -> Column:
    inner = F.array_join(F.array_sort(F.transform(F.map_entries(properties), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ", ")
    return F.when(F.coalesce(F.size(properties) > 0, F.lit(False)), F.concat(F.lit(", properties={"), inner, F.lit("}"))).otherwise(F.lit(""))


def entity_string(id_: Column, name: Column, kind: Column, properties: Column) -> Column:
    """One line that shows an entity; properties are in order of their keys."""
    return F.concat(F.format_string("Entity{id=%s, name=%s, type=%s", id_, name, kind), _properties(properties), F.lit("}"))


def relation_string(id_: Column, name: Column, kind: Column, inverse: Column, symmetric: Column, properties: Column) -> Column:
    return F.concat(F.format_string("Relation{id=%s, name=%s, type=%s, inverseName=%s, symmetric=%s", id_, name, kind, inverse, symmetric.cast("string")), _properties(properties), F.lit("}"))


def triple_string(subject: Column, relation: Column, obj: Column, confidence: Column) -> Column:
    return F.format_string("Triple{subject=%s, relation=%s, object=%s, confidence=%s}", subject, relation, obj, F.format_number(confidence, 3))


def same_row(a: DataFrame, b: DataFrame, key: tuple = ("id",)) -> Column:
    """Whether two rows are the same entity or relation: their ids, of which null is one."""
    out = None
    for k in key:
        out = a[k].eqNullSafe(b[k]) if out is None else out & a[k].eqNullSafe(b[k])
    return out


def same_triple(a: DataFrame, b: DataFrame) -> Column:
    """Whether two triples are the same: subject, relation and object, whatever their ids and confidence."""
    return same_row(a, b, ("subject_id", "relation_id", "object_id"))


def random_string(n: int, *parts: Column) -> Column:
    """``n`` letters and digits that look random and depend on the parts alone, so a task that runs again gives them again."""
    letters = F.lit("0123456789abcdefghijklmnopqrstuvwxyz")
    number = lambda i: F.conv(F.substring(F.md5(F.concat_ws("#", *parts, i.cast("string"))), 1, 12), 16, 10).cast("long")
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.substr(letters, (F.pmod(number(i), F.lit(36)) + 1).cast("int"), F.lit(1))), "")
