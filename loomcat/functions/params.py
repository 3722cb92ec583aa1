"""Checked request parameters. A wrong one raises ParameterError; status is what a web layer would send."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

#: Terms with their levels, languages, days and orders that may be asked for (fixed values).
TERMS = {"spring": ("u", "g"), "summer": ("s",), "fall": ("a", "r")}
LANGS = ("zh", "en", "ja", "ko", "fr", "de", "es", "ru")
WEEKDAYS = ("周一", "周二", "周三", "周四", "周五", "周六", "周日")
SORTS = ("", "name_asc", "name_desc", "pinyin", "pinyin_desc", "credits_asc", "credits_desc", "time_asc", "random")
_ID = re.compile(r"[ugsar][1-9][0-9]*")


class ParameterError(ValueError):
    def __init__(self, message: str, status: int = 422):
        super().__init__(message)
        self.status = status


def whole(value: object, least: int, most: int, what: str) -> int:
    """A whole number in a range; True and False are none."""
    if isinstance(value, bool) or not isinstance(value, int) or not least <= value <= most:
        raise ParameterError(f"{what}: a whole number from {least} to {most} is wanted")
    return value


def one_of(value: object, choices: tuple[str, ...], what: str) -> str:
    if not isinstance(value, str) or value not in choices:
        raise ParameterError(f"{what}: not one of the choices")
    return value


@dataclass(frozen=True)
class Page:
    page: int = 1
    size: int = 50
    most: int = 200

    def __post_init__(self):
        whole(self.page, 1, 10_000, "page")
        whole(self.size, 1, self.most, "page size")

    @property
    def offset(self) -> int:
        return (self.page - 1) * self.size


@dataclass(frozen=True)
class Search:
    """A catalog search. credits is text; blank filters nothing."""

    q: str = ""
    type: str = ""
    category: str = ""
    credits: str = ""
    department: str = ""
    weekday: str = ""
    grading: str = ""
    classroom: str = ""
    sort: str = ""
    random_seed: int = 0
    lang: str = "zh"
    term: str = "fall"
    page: Page = Page()

    def __post_init__(self):
        one_of(self.term, tuple(TERMS), "term")
        one_of(self.lang, LANGS, "lang")
        one_of(self.sort, SORTS, "sort")
        one_of(self.weekday, ("", *WEEKDAYS), "weekday")
        if not isinstance(self.page, Page):
            raise ParameterError("page")
        self.credit_value  # noqa: B018  checks it

    @property
    def credit_value(self) -> float | None:
        if not isinstance(self.credits, str):
            raise ParameterError("credits: text is wanted")
        if not self.credits:
            return None
        try:
            value = float(self.credits)
        except ValueError:
            raise ParameterError("credits: a number is wanted") from None
        if not math.isfinite(value):
            raise ParameterError("credits: a finite number is wanted")
        return value


def split_id(value: object) -> tuple[str, str, int]:
    """Term, level and local number of an id such as u12."""
    if not isinstance(value, str) or not _ID.fullmatch(value):
        raise ParameterError("no such entry", 404)
    return next(t for t, levels in TERMS.items() if value[0] in levels), value[0], int(value[1:])


def review_query(value: object, most: int = 120) -> str:
    if not isinstance(value, str) or len(value) > most:
        raise ParameterError("query: text of at most 120 characters is wanted")
    return value.strip()


def message_text(value: object, most: int = 500) -> str:
    text = value.strip() if isinstance(value, str) else ""
    if not 1 <= len(text) <= most:
        raise ParameterError("content: 1 to 500 characters are wanted")
    return text
