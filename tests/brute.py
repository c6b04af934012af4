"""Row-by-row review for small inputs: every entry against every group, the slow and obvious way."""

from __future__ import annotations

REQUIRED = [
    ("日期", "date"),
    ("姓名", "name"),
    ("一级分类", "category"),
    ("细分", "subcategory"),
    ("企业名称&官网", "company_raw"),
    ("环节", "stage"),
]


def distinct(words):
    seen = []
    for word in words:
        if word and word not in seen:
            seen.append(word)
    return seen


def points(group, category, subcategory, scope, stage):
    """group: (levels, [(module, keywords), ...]) in rule order."""
    levels, members = group
    total, lines = 0, []
    for label, value in (("分类命中：", category), ("细分命中：", subcategory)):
        if value in levels and value != "":
            total, lines = total + 20, lines + [label + value]
    for module, _ in members:
        if module != "" and stage.find(module) >= 0:
            total, lines = total + 5, lines + ["环节模块命中：" + module]
    words = distinct(w for _, keywords in members for w in keywords)
    for text, weight, cap, label in ((scope, 12, 45, "经营范围关键词："), (stage, 6, 20, "录入环节关键词：")):
        hits = [w for w in words if text.count(w)]
        total += cap if len(hits) * weight > cap else len(hits) * weight
        if hits:
            lines.append(label + "、".join(hits[:6]))
    return (100 if total > 100 else total), lines


def review_row(entry, rules, info):
    """entry: dict; rules: rows of (l1, l2, l3, module, keywords); info: (scope, success, error) or None."""
    absent = [header for header, field in REQUIRED if entry[field] == ""]
    if absent:
        return ("信息缺失", 0, "信息缺失", "必填字段缺失：" + "、".join(absent), "", True)
    if info is None:
        return ("无法判断", 0, "企业信息缺失", "未查询到企业信息", "", True)
    scope, success, error = info
    if not success:
        return ("无法判断", 0, "企业信息缺失", error, "", True)

    order = distinct_keys(rules)
    groups = [(key, [(r[3], r[4]) for r in rules if r[:3] == key]) for key in order]
    filed = [g for g in groups if g[0][1] == entry["category"] and g[0][2] == entry["subcategory"]]
    current, lines = points(filed[-1], entry["category"], entry["subcategory"], scope, entry["stage"]) if filed else (0, [])
    if scope == "":
        return ("无法判断", current, "经营范围缺失", "企业经营范围为空，无法进行分类匹配", "", True)
    if filed and current >= 80:
        return ("正确", current, "", "；".join(lines), "", False)
    ranked = sorted(
        ((points(g, "", "", scope, ""), -i, g[0]) for i, g in enumerate(groups)), key=lambda c: (c[0][0], c[1]), reverse=True
    )
    if ranked and ranked[0][0][0] >= 35 and (not filed or current < 60):
        (score, why), _, key = ranked[0]
        return ("错误", max(score, 60), "细分错误", "经营范围更匹配建议分类：" + "；".join(why), f"{key[1]} / {key[2]}", False)
    return ("疑似错误", current, "证据不足", "经营范围与当前分类只有部分匹配，建议人工复核", "", True)


def distinct_keys(rules):
    keys = []
    for rule in rules:
        if rule[:3] not in keys:
            keys.append(rule[:3])
    return keys
