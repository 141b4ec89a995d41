"""Tunable values of the analytics, kept in one frozen dataclass.

The defaults are fixed values: they must equal the reference's for the same
panels, levels, texts and filters. Callers override them per run with
``dataclasses.replace(DEFAULTS, risk_threshold=45)`` and similar.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values (must equal the reference's; natural order) ---------------
# Score levels, best first, with their inclusive lower bounds.
LEVEL_NAMES = ("优秀", "达标", "待巩固", "高风险")
LEVEL_CUTS = (85.0, 70.0, 60.0)
# Filter wildcard used by the dashboard's select boxes.
WILDCARD = "全部"
# Role scopes of the two restricted accounts.
TEACHER_TAGS = ("压疮预防", "跌倒预防", "感染防控")
MANAGER_ORGANIZATION = "安心护理培训中心"
# Recommendation texts of the server-side dashboard ({course}, {tag} filled in).
REC_COURSE_TITLE = "加强「{course}」专项训练"
REC_COURSE_DETAIL = "该课程平均成绩偏低，建议增加{tag}情境案例、短测验和课后复盘任务。"
REC_FIXED = (
    ("对高风险学员建立跟踪清单", "优先关注成绩低、学习进度慢、学习时长不足的学员，安排导师一对一补训。"),
    ("优化课程资源格式组合", "结合资源完成率调整视频、文档、题库和实操清单比例，提高移动端学习效率。"),
)
# Recommendation texts of the filtered view ({course}, {score}, {tag}, {count}).
REC_VIEW_COURSE_TITLE = "加强「{course}」专项训练"
REC_VIEW_COURSE_DETAIL = "该课程均分 {score}，建议增加{tag}案例训练、短测和课后复盘。"
REC_VIEW_RISK_TITLE = "建立高风险学员跟踪清单"
REC_VIEW_RISK_DETAIL = "当前视角下有 {count} 名高风险学员，建议按机构、课程和标签分组补训。"
REC_VIEW_FIXED = ("复盘资源完成率", "结合视频、文档、题库和清单完成率，调整课前预习与课后巩固资源比例。")
# The numbers in ``Params`` below are fixed values too.
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Params:
    """Thresholds, weights and caps of the panels (reference values by default)."""

    level_names: tuple[str, ...] = LEVEL_NAMES
    level_cuts: tuple[float, ...] = LEVEL_CUTS
    pass_score: float = 60.0
    weak_below: float = 60.0
    risk_threshold: float = 38.0
    # The thresholds that the page's filter offers.
    risk_steps: tuple[float, ...] = (0.0, 30.0, 38.0, 45.0, 55.0)
    # risk = max(0, base - score_weight*final - progress_weight*progress
    #              - min(minutes / minutes_divisor, minutes_cap))
    risk_base: float = 100.0
    score_weight: float = 0.72
    progress_weight: float = 0.18
    minutes_divisor: float = 12.0
    minutes_cap: float = 10.0
    # Output rounding and caps.
    decimals: int = 2
    risk_table_limit: int | None = 120
    weak_courses: int = 3
    recommendations: int = 5
    weak_courses_filtered: int = 2
    recommendations_filtered: int = 4
    wildcard: str = WILDCARD
    teacher_tags: tuple[str, ...] = TEACHER_TAGS
    manager_organization: str = MANAGER_ORGANIZATION
    # Distinct counts are exact by default. Setting a relative standard
    # deviation (e.g. 0.01) switches them to HyperLogLog++ sketches, which
    # aggregate in one map-side pass without shuffling (key, value) pairs.
    approx_distinct_rsd: float | None = None
    # A dimension is broadcast only if the plan's size statistics (file
    # lengths, no job) stay below this; others are left to the optimizer.
    broadcast_max_bytes: int = 8 << 20


DEFAULTS = Params()
