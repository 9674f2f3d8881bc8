"""Settings of the engine, with the defaults of its domain."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

# Words by which receipt rows are classified; order is priority.
KEYWORDS: dict[str, list[str]] = {
    "subtotal": ["subtotal", "sub total", "sub-total", "net amount", "net total", "bill excl", "小计", "不含税", "金额合计"],
    "tax": ["sales tax", "tax", "vat", "gst", "hst", "税额", "增值税", "税金"],
    "tip": ["gratuity", "service charge", "service chg", "tip", "小费", "服务费"],
    "tendered": ["tendered", "c/card", "card", "purchase", "实付", "刷卡"],
    "total": ["grand total", "balance due", "amount due", "to pay", "total due", "bill total", "total", "价税合计", "应付", "总计", "合计", "交易金额", "paid", "金额", "amount"],
    "ignore": ["new total", "nev total", "nen total", "suggested", "suggestion", "gratuity suggestions"],
    "date_hint": ["date", "invoice date", "开票日期", "日期", "时间", "time"],
}

# Words of card slips.
CARD_SLIP_WORDS = ["签购单", "商户存根", "持卡人存根", "存根", "凭证号", "批次号", "授权码", "交易类型", "终端号", "商户号", "pos", "merchant copy", "cardholder copy", "customer copy", "auth code", "approval code", "approval", "approved", "terminal id", "batch", "swiped", "chip read", "entry mode", "rrn", "tvr:", "tsi:", "aid:", "stan", "txn"]

#: A card payment exceeds the printed total by this factor at most.
TIP_RATIO_PERCENT = 135
#: Days within which amounts that match are suspected of being one transaction.
SUSPECT_GAP_DAYS = 3
#: OCR lines of a lower score are dropped.
LEAST_OCR_SCORE = 0.45


@dataclass(frozen=True)
class LinkSettings:
    enabled: bool = True
    mode: str = "skip"
    date_tolerance_days: int = 0
    #: Readings that a note names; of more, the rest is a number.
    most_named: int = 100

    def __post_init__(self) -> None:
        if self.mode not in ("skip", "mark"):
            raise ValueError(f"unknown dedup mode {self.mode!r}")


@dataclass(frozen=True)
class TemplateSettings:
    columns: dict[str, list[str]] = field(default_factory=lambda: {"invoice_date": ["B", "C"], "total_incl_tax": ["K"]})
    sheet: str | None = None
    header_row: int = 3
    start_row: int = 5


@dataclass(frozen=True)
class Settings:
    keywords: dict[str, list[str]] = field(default_factory=lambda: KEYWORDS)
    date_order: str = "dmy"
    segment: bool = True
    dpi: int = 200
    prefer_text_layer: bool = True
    link: LinkSettings = LinkSettings()
    template: TemplateSettings = TemplateSettings()


def load(path: str | Path) -> Settings:
    """Settings from a YAML file; what it leaves out keeps its default."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    link, template, ocr = raw.get("dedup") or {}, raw.get("template") or {}, raw.get("ocr") or {}
    columns = {k: v if isinstance(v, list) else [v] for k, v in (template.get("columns") or {}).items()}
    return Settings(
        keywords={**KEYWORDS, **(raw.get("keywords") or {})},
        date_order=(raw.get("parsing") or {}).get("date_order", "dmy"),
        segment=(raw.get("segment") or {}).get("enabled", True),
        dpi=int(ocr.get("pdf_render_dpi", 200)),
        prefer_text_layer=ocr.get("prefer_pdf_text_layer", True),
        link=LinkSettings(link.get("enabled", True), link.get("mode", "skip"), int(link.get("date_tolerance_days", 0))),
        template=TemplateSettings(columns, template.get("sheet"), int(template.get("header_row", 1)), int(template.get("start_row", int(template.get("header_row", 1)) + 1))) if columns else TemplateSettings(),
    )
