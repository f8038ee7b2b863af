"""All settings of article extraction, frozen: a changed copy is made with dataclasses.replace, and unknown names raise."""

from __future__ import annotations

from dataclasses import dataclass, field

from pressmill.functions.stopwords import NAMES


@dataclass(frozen=True)
class Config:
    min_word_count: int = 300
    min_sentence_count: int = 7
    max_title: int = 200
    max_text: int = 100_000
    max_keywords: int = 35
    max_authors: int = 10
    max_summary: int = 5000
    max_summary_sentences: int = 5
    max_memo: int = 20_000
    memoize_articles: bool = True
    fetch_images: bool = True
    image_ratio: float = 16 / 9
    follow_meta_refresh: bool = False
    use_meta_language: bool = True
    keep_article_html: bool = False
    http_success_only: bool = True
    language: str = "en"
    user_agent: str = "pressmill/0.1"
    headers: dict = field(default_factory=dict)
    request_timeout: float = 7
    proxies: dict = field(default_factory=dict)
    number_threads: int = 10
    ignored_content_types: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.language not in NAMES:
            raise ValueError(f"unknown language {self.language!r}")

    @classmethod
    def for_language(cls, language: str, **other) -> Config:
        """Settings with a language that the pages' own don't override."""
        return cls(language=language, use_meta_language=False, **other)
