"""Label expressions for phases, stages and run states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Processing phases.
PHASES = (
    "setup", "audio_extract", "fingerprint", "funasr", "faster_whisper",
    "quality_gate", "writeback", "verify",
)

# Display labels of phases; setup has none.
PHASE_LABELS = {
    "audio_extract": "音频提取",
    "fingerprint": "视频完整性校验",
    "funasr": "FunASR 转写",
    "faster_whisper": "faster-whisper 转写",
    "quality_gate": "质量门禁",
    "writeback": "写回",
    "verify": "写回",
}

# Display labels of run states.
STATUS_LABELS = {
    "prepared": "已准备",
    "running": "运行中",
    "staged_all": "已暂存（全部候选）",
    "staged_partial": "已暂存（部分候选）",
    "committed": "已完成",
    "unknown": "未知",
}

# Words in a failure reason and the stage they point to; the first hit decides.
STAGE_WORDS = (
    (("质量门禁",), "质量门禁"),
    (("音频提取失败",), "音频提取"),
    (("engine=funasr", "FunASR"), "FunASR 转写"),
    (("engine=faster-whisper", "faster-whisper"), "faster-whisper 转写"),
    (("写回", "替换", "备份", "回滚", "复核"), "写回"),
    (("扫描",), "扫描"),
)

PRIMARY_ENGINE = "funasr"
SECONDARY_ENGINE = "faster_whisper"


def _lookup(labels: dict[str, str], key: Column, default: Column) -> Column:
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def phase_label(phase: Column, fallback: Column) -> Column:
    return _lookup(PHASE_LABELS, phase, fallback)


def status_label(status: Column) -> Column:
    return _lookup(STATUS_LABELS, status, status)


def detect_stage(reason: Column, fallback: Column) -> Column:
    stage = fallback
    for words, label in reversed(STAGE_WORDS):
        hit = reduce(lambda a, b: a | b, [F.contains(reason, F.lit(w)) for w in words])
        stage = F.when(hit, F.lit(label)).otherwise(stage)
    return stage


def engine_phase(engine: Column, primary: str = PRIMARY_ENGINE, secondary: str = SECONDARY_ENGINE) -> Column:
    return F.when(F.translate(engine, "-", "_") == primary, primary).otherwise(secondary)
