"""String expressions: tokenising, similarity and the small accessors of topics and documents."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = r"[^\p{L}\p{M}\p{N}]+"


@dataclass(frozen=True)
class TokenizerConfig:
    """What becomes a token. Lengths count code points."""

    stop_words: frozenset[str] = frozenset()
    min_length: int = 2
    max_length: int = 50
    lowercase: bool = True
    remove_numbers: bool = False
    bigrams: bool = False


class TokenizerBuilder:
    """A configuration, put together step by step."""

    def __init__(self, config: TokenizerConfig | None = None) -> None:
        self._config = config or TokenizerConfig()

    def _with(self, **changes: object) -> TokenizerBuilder:
        return TokenizerBuilder(replace(self._config, **changes))

    def stop_words(self, words: frozenset[str] | set[str]) -> TokenizerBuilder:
        return self._with(stop_words=frozenset(words))

    def more_stop_words(self, words: set[str]) -> TokenizerBuilder:
        return self._with(stop_words=self._config.stop_words | set(words))

    def min_length(self, n: int) -> TokenizerBuilder:
        return self._with(min_length=n)

    def max_length(self, n: int) -> TokenizerBuilder:
        return self._with(max_length=n)

    def lowercase(self, on: bool = True) -> TokenizerBuilder:
        return self._with(lowercase=on)

    def remove_numbers(self, on: bool = True) -> TokenizerBuilder:
        return self._with(remove_numbers=on)

    def bigrams(self, on: bool = True) -> TokenizerBuilder:
        return self._with(bigrams=on)

    def build(self) -> TokenizerConfig:
        return self._config


def tokenize(text: Column | str, config: TokenizerConfig = TokenizerConfig()) -> Column:
    """Tokens in order; with bigrams, pairs of neighbours that are left follow all of them. Null text: null."""
    text = F.col(text) if isinstance(text, str) else text
    tokens = F.split(F.lower(text) if config.lowercase else text, SEPARATOR)
    keep = lambda t: F.length(t).between(max(1, config.min_length), config.max_length)
    tokens = F.filter(tokens, keep)
    if config.stop_words:
        stop = F.array(*[F.lit(w) for w in sorted(config.stop_words)])
        tokens = F.filter(tokens, lambda t: ~F.array_contains(stop, F.lower(t)))
    if config.remove_numbers:
        tokens = F.filter(tokens, lambda t: ~t.rlike(r"^\p{N}+$"))
    return with_bigrams(tokens) if config.bigrams else tokens


def bigrams(tokens: Column) -> Column:
    """Pairs of neighbours, joined by _."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, 1, n), F.slice(tokens, 2, n), lambda a, b: F.concat_ws("_", a, b))


def with_bigrams(tokens: Column) -> Column:
    return F.when(F.size(tokens) >= 2, F.concat(tokens, bigrams(tokens))).otherwise(tokens)


def unique_tokens(text: Column | str, config: TokenizerConfig = TokenizerConfig()) -> Column:
    return F.array_distinct(tokenize(text, config))


def stream_tokens(text: Column | str) -> Column:
    """The simple rule of the incremental path: words between white space, longer than two characters."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: F.length(t) > 2)


def trigrams(term: Column) -> Column:
    """Distinct runs of three characters; a shorter term is its own single run."""
    n = F.length(term)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(term, i, F.lit(3)))
    return F.when(n < 3, F.array(term)).otherwise(F.array_distinct(runs))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def keyword_summary(keywords: Column | str, count: int = 5) -> Column:
    """The first terms, with commas between."""
    keywords = F.col(keywords) if isinstance(keywords, str) else keywords
    return F.array_join(F.transform(F.slice(keywords, 1, count), lambda k: k["term"]), ", ")


def keyword_at(keywords: Column | str, index: int) -> Column:
    """The keyword at an index from 0; null outside."""
    return F.try_element_at(F.col(keywords) if isinstance(keywords, str) else keywords, F.lit(index + 1)) if index >= 0 else F.lit(None)


def topic_name(topic_id: Column | str) -> Column:
    topic_id = F.col(topic_id) if isinstance(topic_id, str) else topic_id
    return F.when(topic_id == -1, "outlier").otherwise(F.concat(F.lit("topic_"), topic_id.cast("string")))


#: A metadata value has one field for each kind that it may be of.
METADATA = "map<string, struct<s: string, i: bigint, d: double, b: boolean, ts: timestamp, arr: array<string>>>"
_KINDS = {"string": "s", "int": "i", "double": "d", "bool": "b", "date": "ts", "strings": "arr"}


def metadata_value(metadata: Column | str, key: str, kind: str) -> Column:
    """A value of a kind; null if the key is missing or of another kind."""
    metadata = F.col(metadata) if isinstance(metadata, str) else metadata
    return F.try_element_at(metadata, F.lit(key))[_KINDS[kind]]


def is_outlier(label: Column | str) -> Column:
    return (F.col(label) if isinstance(label, str) else label) == -1


def is_leaf(children: Column | str) -> Column:
    return F.coalesce(F.size(children), F.lit(0)) == 0


def is_highly_diverse(diversity: Column | str) -> Column:
    return (F.col(diversity) if isinstance(diversity, str) else diversity) > 0.9


def is_low_redundancy(redundancy: Column | str) -> Column:
    return (F.col(redundancy) if isinstance(redundancy, str) else redundancy) < 0.1


def all_positive(score: Column | str) -> Column:
    """Aggregate: whether every score is above 0."""
    return F.bool_and((F.col(score) if isinstance(score, str) else score) > 0)
