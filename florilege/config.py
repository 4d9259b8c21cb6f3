"""Settings of an extraction: one dataclass, four presets, and a YAML reader."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from pathlib import Path

#: Words that make a sentence specific, by preset.
FIRST_WORDS = ("this", "that", "these", "those", "he", "she", "her", "his")
PRONOUNS = ("i", "me", "my", "we", "us", "our", "you", "your")


@dataclass(frozen=True)
class Settings:
    """Everything an extraction can be told; the defaults are those of the geonames preset."""

    people_group: str = "geonames"
    domain: str | None = None
    # Labels, thresholds and limits that results depend on.
    candidate_labels: tuple[str, ...] = ("clothing", "food", "drink", "tradition", "ritual")
    counter_labels: tuple[str, ...] = ("advertisement", "business", "politics")
    required_labels: tuple[str, ...] = ()
    max_length: int = 100
    bad_first_words: tuple[str, ...] = FIRST_WORDS
    pronouns: tuple[str, ...] = PRONOUNS
    excluded_entities: tuple[str, ...] = ("ORG", "PERSON")
    excluded_filters: tuple[str, ...] = ()
    domain_tails: tuple[str, ...] = ("tk",)
    positive_threshold: float = 0.5
    negative_threshold: float = 0.3
    max_sentences: int = 50_000
    ward_threshold: float = 1.5
    min_cluster_size: int = 3
    cluster_limit: int = 500
    idf_threshold: float = 0.8
    concept_threshold: float = 0.6
    concept_share: float = 0.6
    max_gram: int = 3
    min_rep_length: int = 20
    min_rep_tokens: int = 3
    diversity: float = 1 / 3
    cross_facet: float = 0.5
    prompt_limit: int = 1800
    ancestor_tries: int = 11
    overwrite_labels: bool = False
    overwrite_reps: bool = False
    aspects: dict[str, str] = field(default_factory=lambda: {"ritual": "rituals", "tradition": "traditions", "drink": "drinks"})

    def __post_init__(self) -> None:
        if not 0 <= self.positive_threshold <= 1 or not 0 <= self.negative_threshold <= 1:
            raise ValueError("thresholds are shares")
        if self.max_sentences < 1 or self.cluster_limit < 1 or self.max_gram < 1:
            raise ValueError("limits are positive")

    @property
    def output_domain(self) -> str:
        return self.domain or self.people_group


GEONAMES = Settings()
RELIGIONS = replace(
    GEONAMES, people_group="religions", candidate_labels=(*GEONAMES.candidate_labels, "religious"), required_labels=("religious",),
    max_length=150, excluded_entities=(), excluded_filters=("remove-past-tense-roots",), aspects={**GEONAMES.aspects, "religious": "other"},
)
OCCUPATIONS = replace(
    GEONAMES, people_group="occupations",
    candidate_labels=("professional", "profession", "occupational", "occupation", "job-related", "food", "drink", "clothing", "ritual", "tradition", "behaviour"),
    counter_labels=(), required_labels=("professional",), max_length=120, bad_first_words=("the", "this", "that", "these", "those"),
    pronouns=(*PRONOUNS, "he", "him", "his", "she", "her"),
    excluded_entities=("PERSON", "ORG", "WORK_OF_ART", "EVENT", "GPE", "NORP", "PRODUCT", "LANGUAGE"),
    cluster_limit=300, overwrite_labels=True, overwrite_reps=True, aspects={**GEONAMES.aspects, "professional": "other", "behaviour": "behaviors"},
)
REGIONS = replace(GEONAMES, people_group="regions")
PRESETS = {s.people_group: s for s in (GEONAMES, RELIGIONS, OCCUPATIONS, REGIONS)}


#: Where a file that nests settings by component has them; what else it has (storage, models, files) is for other readers.
NESTED = {
    "candidate_labels": "candidate_labels", "counter_labels": "counter_labels", "required_true_labels": "required_labels",
    "generic_sentence_filter.filter.is-short-enough.max_length": "max_length",
    "generic_sentence_filter.filter.has-no-bad-first-word.words": "bad_first_words",
    "generic_sentence_filter.filter.has-no-pronouns.words": "pronouns",
    "generic_sentence_filter.filter.not-from-unreliable-source.domain_tails": "domain_tails",
    "generic_sentence_filter.filter.all-propn-have-acceptable-ne-labels.excluded": "excluded_entities",
    "generic_sentence_filter.excluded_filters": "excluded_filters",
    "culture_classifier.candidate_labels": "candidate_labels", "culture_classifier.counter_labels": "counter_labels", "culture_classifier.required_true_labels": "required_labels",
    "culture_classifier.overwrite": "overwrite_labels",
    "clustering_component.query_db.positive_threshold": "positive_threshold", "clustering_component.query_db.negative_threshold": "negative_threshold",
    "clustering_component.query_db.max_sentences": "max_sentences", "clustering_component.hac.threshold": "ward_threshold",
    "representative_generator.min_cluster_size": "min_cluster_size", "representative_generator.cluster_limit": "cluster_limit", "representative_generator.overwrite": "overwrite_reps",
    "ranking_component.idf_threshold": "idf_threshold", "ranking_component.concept_threshold": "concept_threshold", "ranking_component.aspect_map": "aspects",
}


def flattened(given: dict) -> dict:
    """Settings nested by component, as fields by name. The group is one of the presets that has a section of its own."""

    def leaf(path: str):
        at = given if "." not in path else given.get("pipeline_components") or {}
        for name in path.split("."):
            at = at.get(name) if isinstance(at, dict) else None
        return at

    found = {field_name: value for path, field_name in NESTED.items() if (value := leaf(path)) is not None}
    group = next((name for name in PRESETS if name in given), None)
    return ({"people_group": group} if group else {}) | found


def parse_settings(text: str) -> Settings:
    """Settings from YAML on top of the preset its people_group names: the fields above, whose unknown names are errors, or a file that
    nests them by component (it has pipeline_components)."""
    import yaml

    given = yaml.safe_load(text) or {}
    if "pipeline_components" in given:
        given = flattened(given)
    base = PRESETS.get(given.get("people_group", "geonames"), GEONAMES)
    known = {f.name for f in fields(Settings)}
    if unknown := set(given) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return replace(base, **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def read_settings(path: str | Path) -> Settings:
    return parse_settings(Path(path).read_text(encoding="utf-8"))
