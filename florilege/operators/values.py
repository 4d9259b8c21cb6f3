"""Fixed values of the ranking rules: word lists and patterns that results depend on."""

# Words that are no concept, by facet.
BAD_CONCEPTS = {
    "food": "menu word food foods cuisine cuisines dish dishes meal meals breakfast lunch dinner restaurant restaurants served serving serves hotel hotels eat eats used cooked".split(),
    "drink": "menu restaurant restaurants drink drinks word food foods dish dishes meal meals breakfast lunch dinner".split(),
    "clothing": "clothing clothes word".split(),
    "tradition": "traditions word tradition traditional".split(),
    "ritual": "ritual rituals word".split(),
}

# Words that a representative can't start with.
BAD_REP_STARTS = ("this", "that", "these", "those", "their", "his", "her", "its")

# Patterns that a representative must not match, in any case.
GENERAL = (
    r"(^for ((example)|(instance)|(e\.g\.)))",
    r"(\(\d+\)|(sentence \d+)|(((the)|(this)|(these)|(those)|(that)|(each)|(all))( \w+)? sentences?)|(in this list))",
    r"\bHD wallpaper\b",
)
FOOD_DRINK = (
    r"\b((the menu)|(dining ((rooms?)|(areas?)))|(french doors?)|(brazil(ian)? nuts?)|(vietnam veterans?)|(unsung hero(es)?)|(((the)|(this)|(these)) restaurants?)"
    r"|(North American bison)|(will be served)|(was served)|(the food here)|(will be a mix)|(dining options))\b"
)
SHEPHERDS = r"\b(german shepherds*)\b"
BY_FACET = {"clothing": (*GENERAL, SHEPHERDS), "food": (*GENERAL, FOOD_DRINK), "drink": (*GENERAL, FOOD_DRINK), "tradition": (*GENERAL, SHEPHERDS)}

# The further rules for occupations.
OCCUPATION_STARTS = ("the", "both", "none", "no", "every")
OCCUPATION_ENTITIES = ("PERSON", "NORP", "ORG", "GPE", "LOC", "LAW", "LANGUAGE", "DATE", "TIME", "PERCENT", "MONEY", "QUANTITY", "ORDINAL", "CARDINAL")
OCCUPATION_PRONOUNS = ("he", "she", "his", "her", "him")
OCCUPATION_AUXILIARIES = ("were", "was", "have")
OCCUPATION_WORDS = ("™", "lvl")
# A pattern that a representative must not match.
OCCUPATION_PATTERN = (
    r"\b(((nanny|childcare) agenc(y|ies))|(Four Seasons)|(Nanny McPhee)|(net nanny)|(Boss Design)|(Iyengar Yoga)|(Two Inch Astronaut)|(Hiawatha Care Center)|(Hilltop Manor)|(Reg Barber)"
    r"|(Elm Street Pomade)|(Crafted North)|(Jacques Bar)|(Flair Bartender)|(The Hitman's Bodyguard)|(Results:)|(Label:)|(Butcher Box)|(Belsize Park London)|(Jeepney routes)|(Top Cars)"
    r"|(Image Luxury Cars)|(Area of specialty:)|(A K M Studio)|(Urban Style)|(Hair Affair)|(Kudos Hair)|(Hip Headz)|(Pure Hair And Beauty)|(Gel Triq)|(Hair & Beauty Club)|(M & M Hairdressing)"
    r"|(Chow chows)|(is an?( \w)? ((hairdressers?)|(sculptors?)|(artists?)))|(Magic Oz)|(Reed Tire)|(PC tune-up)|(Drum On)|(A Choice Nanny)|(Martindale)|(Tutunov Piano Series)|(Logbook Pro)"
    r"|(the situation)|(Douglas-Sarpy)|(Sailor Pluto)|(Dacron)|(Dubarry's)|(Salesman:)|(Hyunn-Min)|(Casino Luck)|(NextGen Gaming)|(IGT)|(About Company Novomatic)|(BPH)|(Play'n Go)"
    r"|(Net Entertainment)|(Realtime Gaming))\b"
)
# Names that a representative must not hold.
COMMON_NAMES = (
    "Smith Anderson Clark Wright Mitchell Johnson Thomas Rodriguez Lopez Perez Williams Jackson Lewis Hill Roberts Jones White Lee Scott Turner Brown Harris Walker Green Phillips Davis Martin Hall Adams Campbell "
    "Miller Thompson Allen Baker Parker Wilson Garcia Young Gonzalez Evans Moore Martinez Hernandez Nelson Edwards Taylor Robinson King Carter Collins James David Christopher George Ronald John Richard Daniel "
    "Kenneth Anthony Robert Charles Paul Steven Kevin Michael Joseph Mark Edward Jason William Donald Brian Jeff Mary Jennifer Lisa Sandra Michelle Patricia Maria Nancy Donna Laura Linda Susan Karen Carol Sarah "
    "Barbara Margaret Betty Ruth Kimberly Elizabeth Dorothy Helen Sharon Deborah Jonathan Stephen Julia Emily Carolyn Jessica Amanda Melissa Heather Amy Angela Stephanie Nicole Christine Rebecca Kelly Teresa "
    "Cynthia Kathleen Alicia Denise Tammy Brenda Anna Debra Virginia Katherine Pamela Catherine Christina Samantha Janet Debbie Julie Lori Martha Andrea Frances Ann Alice Mitch Juha Igor Jari Jukka Jussi Jyrki"
).split()
