"""The two standard step lists: articles and statements."""

from newsframe.functions import labels, stem, text
from newsframe.operators.sentiment import sentiment_of
from newsframe.plans.steps import Steps


def _join(*names: str):
    return lambda col: text.join_columns(*[col(name) for name in names])


def article_steps(stop_words: list[str] | None = None) -> Steps:
    """Flag, cleaned and tokenised content, title, authors and domain, and the combined feature columns."""
    def without_stop_words(words):
        return text.remove_stop_words(words, stop_words)

    return Steps([
        (labels.article_flag, "type", "type_binary"),
        (text.clean_domain, "domain"),
        (text.clean_authors, "authors"),
        (text.clean_text, "content", "content_cleaned"),
        (text.tokens, "content_cleaned", "content_tokenized"),
        (without_stop_words, "content_tokenized", "content_no_swords"),
        (stem.stem_words, "content_no_swords", "content_no_swords_stemmed"),
        (text.joined, "content_no_swords_stemmed", "content_no_swords_combined"),
        (lambda title: text.joined(stem.stem_words(without_stop_words(text.tokens(text.clean_text(title))))), "title"),
        (_join("content_no_swords_combined", "authors"), None, "content_authors"),
        (_join("content_no_swords_combined", "title"), None, "content_title"),
        (_join("content_no_swords_combined", "domain"), None, "content_domain"),
        (_join("content_no_swords_combined", "domain", "authors", "title"), None,
         "content_no_swords_domain_authors_title"),
    ])


def article_sentiment(lexicon: dict | None = None) -> Steps:
    return Steps([(lambda words: sentiment_of(words, lexicon), "content_no_swords", "sentence_analysis_no_swords")])


def statement_steps(stop_words: list[str] | None = None, lexicon: dict | None = None) -> Steps:
    """Flag, short id, cleaned words and text, sentiment."""
    return Steps([
        (labels.statement_flag, "label", "label_binary"),
        (labels.statement_id, "id"),
        (lambda cell: stem.stem_words(text.remove_stop_words(text.tokens(text.clean_text(cell)), stop_words)),
         "statement", "statement_cleaned"),
        (text.joined, "statement_cleaned", "statement_combined"),
        (lambda words: sentiment_of(words, lexicon), "statement_cleaned", "sentence_analysis"),
    ])
