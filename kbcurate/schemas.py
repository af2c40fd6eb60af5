"""Fixed vocabulary: tracked properties, relation and fact types, class roots, dump schema."""

from __future__ import annotations

from dataclasses import dataclass, field

# Property ids of the source knowledge graph.
INSTANCE_OF, SUBCLASS_OF = "P31", "P279"
PART_OF, LOCATED_IN, COUNTRY, JURISDICTION = "P361", "P131", "P17", "P1001"
OFFICIAL_LANGUAGE, LANGUAGE_OF_WORK = "P37", "P407"
BIRTH_DATE, DEATH_DATE, BIRTHPLACE, POSITION, CITIZENSHIP = "P569", "P570", "P19", "P39", "P27"
OCCUPATION, ISO_CODE, WEBSITE = "P106", "P297", "P856"
ISO_639_1, ISO_639_2, ISO_639_3, WIKIMEDIA_CODE = "P218", "P219", "P220", "P424"

RELATION_TYPES = [
    SUBCLASS_OF, INSTANCE_OF, PART_OF, LOCATED_IN, COUNTRY, JURISDICTION,
    OFFICIAL_LANGUAGE, LANGUAGE_OF_WORK,
]
DATE_TYPES = [BIRTH_DATE, DEATH_DATE]
FACT_TYPES = [BIRTH_DATE, DEATH_DATE, BIRTHPLACE, POSITION, CITIZENSHIP]
CLAIM_KEYS = RELATION_TYPES + FACT_TYPES + [
    OCCUPATION, ISO_CODE, WEBSITE, ISO_639_1, ISO_639_2, ISO_639_3, WIKIMEDIA_CODE,
]

# Items the import rules name.
HUMAN, POLITICIAN, UMBRELLA_PROJECT = "Q5", "Q82955", "Q210588"
PROJECT_CLASS = "Q10876391"

SOURCE_STATUS = ["PROCESSING", "DONE"]
SOURCE_ERRORS = [
    "FETCH_ERROR", "TIMEOUT", "BROWSER_ERROR", "INVALID_CONTENT", "PIPELINE_ERROR",
]


@dataclass(frozen=True)
class EntityType:
    """One typed entity table: the class tree it is drawn from and how it is used."""

    name: str
    roots: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    fact_type: str | None = None
    indexed: bool = False
    semantic_ratio: float = 0.0


# Class roots and ignored branches.
ENTITY_TYPES = {
    t.name: t
    for t in [
        EntityType(
            "Country",
            ["Q6256", "Q3624078", "Q20181813", "Q1520223", "Q1489259", "Q1048835"],
            [], CITIZENSHIP, True, 0.4,
        ),
        EntityType("Language", ["Q34770"]),
        EntityType("Location", ["Q486972", "Q56061"], [], BIRTHPLACE, True, 0.3),
        EntityType(
            "Position",
            ["Q4164871", "Q29645880", "Q29645886", "Q707492"],
            ["Q114962596", "Q193622", "Q60754876", "Q618779", "Q4240305", "Q120560",
             "Q2977", "Q63187345", "Q29982545", "Q12737077", "Q4504549"],
            POSITION, True, 0.4,
        ),
        EntityType("WikipediaProject"),
        EntityType("Politician", indexed=True),
    ]
}

_CLAIM = (
    "struct<id:string,rank:string,"
    "mainsnak:struct<snaktype:string,datavalue:struct<type:string,value:string>>,"
    "qualifiers:string,references:string>"
)


def dump_schema(claim_keys: list[str] = CLAIM_KEYS) -> str:
    """Schema of one dump entity. Claims are a struct of the used properties only, so the JSON
    reader skips all others while it parses; declared-string fields keep nested JSON verbatim."""
    claims = ",".join(f"{key}:array<{_CLAIM}>" for key in claim_keys)
    text_map = "map<string,struct<value:string>>"
    return (
        f"struct<id:string,labels:{text_map},descriptions:{text_map},"
        f"aliases:map<string,array<struct<value:string>>>,"
        f"sitelinks:map<string,struct<title:string>>,claims:struct<{claims}>>"
    )
