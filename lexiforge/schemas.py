"""Explicit schemas for every input relation, and the fixed value tables.

Nothing is inferred: readers pass these ``StructType``s to Spark.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, F, B = (T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(),
                    T.FloatType(), T.BooleanType())


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# --- card relations --------------------------------------------------------

# Source printings: every column as stored (numbers-as-text kept as text).
PRINTINGS = _struct(
    ("uuid", S), ("name", S), ("asciiName", S), ("side", S), ("manaCost", S),
    ("manaValue", S), ("faceConvertedManaCost", S), ("type", S),
    ("power", S), ("toughness", S), ("loyalty", S), ("defense", S),
    ("rarity", S), ("layout", S), ("language", S),
    ("colors", S), ("colorIdentity", S), ("colorIndicator", S), ("keywords", S),
    ("types", S), ("subtypes", S), ("supertypes", S), ("subsets", S),
    ("leadershipSkills", S), ("cardParts", S), ("text", S), ("originalText", S),
    ("edhrecRank", I), ("edhrecSaltiness", F),
)

LEGALITIES = _struct(("uuid", S), ("modern", S))
RULINGS = _struct(("uuid", S), ("text", S))

# The projected card relation (order of the canonical projection, P-1).
CARD_COLUMNS = [
    "uuid", "name", "asciiName", "faceConvertedManaCost", "manaCost", "type",
    "power", "toughness", "loyalty", "defense", "colorIdentity", "colorIndicator",
    "colors", "edhrecRank", "edhrecSaltiness", "keywords", "language", "layout",
    "leadershipSkills", "manaValue", "rarity", "side", "types", "subtypes",
    "supertypes", "subsets", "text", "originalText", "cardParts",
]

# --- combo document (one JSON object with a ``variants`` array) ------------

_USE = _struct(
    ("card", _struct(("oracleId", S), ("name", S))),
    ("zoneLocations", T.ArrayType(S)), ("battlefieldCardState", S),
    ("exileCardState", S), ("libraryCardState", S), ("mustBeCommander", B),
    ("quantity", I),
)
_REQUIRE = _struct(
    ("template", _struct(("id", L), ("name", S))),
    ("zoneLocations", T.ArrayType(S)), ("battlefieldCardState", S),
    ("exileCardState", S), ("libraryCardState", S), ("graveyardCardState", S),
    ("mustBeCommander", B), ("quantity", I),
)
_PRODUCE = _struct(
    ("feature", _struct(("id", L), ("name", S), ("uncountable", B))),
    ("quantity", I),
)
VARIANT = _struct(
    ("id", S), ("manaNeeded", S), ("manaValueNeeded", I), ("identity", S),
    ("variantCount", I), ("otherPrerequisites", S), ("description", S), ("notes", S),
    ("of", T.ArrayType(_struct(("id", L)))),
    ("includes", T.ArrayType(_struct(("id", L)))),
    ("uses", T.ArrayType(_USE)),
    ("requires", T.ArrayType(_REQUIRE)),
    ("produces", T.ArrayType(_PRODUCE)),
)
VARIANTS_DOC = _struct(("variants", T.ArrayType(VARIANT)))

# --- QA, documents, queries ------------------------------------------------

MESSAGE = _struct(("role", S), ("content", S))
CONVERSATION = T.ArrayType(MESSAGE)
QA = _struct(("group", S), ("builder", S), ("conversations", CONVERSATION))
STATIC_QA = _struct(("question", S), ("answer", S))

DOC_META = _struct(
    ("name", S), ("mana_cost", S), ("cmc", D), ("color_identity", S), ("type", S),
    ("power", S), ("toughness", S), ("rarity", S), ("loyalty", S), ("side", S),
)

# ===========================================================================
# FIXED VALUES — these must equal the source system's values for the output
# text to match. Stated plainly, in their natural order.
# ===========================================================================

COLOR_ORDER = "WUBRGC"

COLORS = {  # member name -> code
    "WHITE": "W", "BLUE": "U", "BLACK": "B", "RED": "R", "GREEN": "G",
    "COLORLESS": "C",
}

COLOR_IDENTITIES = {  # member name -> canonical code
    "MONO_WHITE": "W", "MONO_BLUE": "U", "MONO_BLACK": "B", "MONO_RED": "R",
    "MONO_GREEN": "G",
    "AZORIUS": "WU", "ORZHOV": "WB", "BOROS": "WR", "DIMIR": "UB", "IZZET": "UR",
    "SELESNYA": "WG", "RAKDOS": "BR", "SIMIC": "UG", "GOLGARI": "BG", "GRUUL": "RG",
    "ESPER": "WUB", "JESKAI": "WUR",
    "BANT": "WUG", "MARDU": "WBR", "ABZAN": "WBG", "GRIXIS": "UBR", "NAYA": "WRG",
    "SULTAI": "UBG", "TEMUR": "URG", "JUND": "BRG",
    "YORE_TILLER": "WUBR", "WITCH_MAW": "WUBG", "INK_TREADER": "WURG",
    "DUNE": "WBRG", "GLINT_EYE": "UBRG",
    "FIVE_COLOR": "WUBRG",
    "COLORLESS": "C",
}

CARD_TYPES = {  # member name -> value
    "LAND": "Land", "CREATURE": "Creature", "ENCHANTMENT": "Enchantment",
    "ARTIFACT": "Artifact", "PLANESWALKER": "Planeswalker", "INSTANT": "Instant",
    "SORCERY": "Sorcery", "BATTLE": "Battle", "TRIBAL": "Tribal",
}

ZONE_PHRASES = {
    "B": "on the battlefield",
    "G": "in the graveyard",
    "H": "in your hand",
    "L": "in the library",
    "E": "exiled",
    "C": "in the command zone",
}

MARKERS = [
    "[END OF COMBO STEPS]",
    "[END OF COMBO RESULT]",
    "[END OF COMBO PREREQUISITES]",
    "[START OF COMBO]",
    "[END OF COMBO]",
]

ANSWER_LIST_DELIMITER = "|"

# Chat-template header strings (llama-3 family); the template is a parameter.
CHAT_BEGIN = "<|begin_of_text|>"
CHAT_HEADER = "<|start_header_id|>{role}<|end_header_id|>\n\n"
CHAT_END = "<|eot_id|>"

SYSTEM_PROMPT = (
    "\n"
    "        You are a Magic the Gathering information bot. \n"
    "        You are here to build Magic the Gathering combos, find synergies, "
    "and answer questions about the game.\n"
    "        You know information about Magic the Gathering combos, cards, and rules. \n"
    "        The word repeat in the steps does not mean to literally repeat the text.\n"
    "        "
)
RAG_PREAMBLE = """
            Higher Relevancy Scores means that information is more relevant.
            """
# Joined as: system + "." + RAG_PREAMBLE + "\n\relevant information:\n" + context
# (the "\r" is part of the fixed text).
RAG_JOIN = "\n\relevant information:\n"

# Question phrasings per card builder; ``{name}`` is the face name (or the
# full name where noted), ``{value}`` the attribute value.
QUESTIONS = {
    "mana_cost": [
        "What is the mana cost of {name}?",
        "Can you tell me the mana cost of {name}?",
        "What's the card mana cost for {name}?",
    ],
    "cmc": [
        "What is the converted mana cost of {name}?",
        "Can you tell me the converted mana cost for {name}?",
        "How much is the converted mana cost of {name}?",
    ],
    "keywords": [
        "What are the keywords for {name}?",
        "Can you tell me the keywords of {name}?",
        "What keywords are associated with {name}?",
    ],
    "colors": [
        "What is the color of {name}?",
        "Can you tell me the color of {name}?",
        "What color is {name}?",
    ],
    "color_identity": [
        "What is the color identity of {name}?",
        "Can you tell me the color identity of {name}?",
        "What colors are included in {name}'s color identity?",
    ],
    "ascii_name": [
        "What is the ascii name of {name}?",
        "What is the plain text version of the name for {name}?",
        "Provide a simplified name for {name}.",
    ],
    "type": [
        "What is the type of {name}?",
        "Can you tell me the type of {name}?",
        "What type is {name}?",
    ],
    "power": [
        "What is the power of {name}?",
        "Can you tell me the power of {name}?",
        "How much power does {name} have?",
    ],
    "text": [
        "What is the text of {name}?",
        "What are the abilities of {name}?",
        "Can you tell me the text of {name}?",
        "What does {name} do?",
    ],
    "loyalty": [
        "What is the loyalty of {name}?",
        "Can you tell me the loyalty of {name}?",
        "What is {name}'s loyalty?",
    ],
    "rarity": [
        "What is the rarity of {name}?",
        "Can you tell me the rarity of {name}?",
        "What rarity is {name}?",
    ],
    "toughness": [
        "What is the toughness of {name}?",
        "Can you tell me the toughness of {name}?",
        "What is {name}'s toughness?",
    ],
    "rulings": [  # full name
        "What are the rulings for {name} card?",
        "Can you tell me the rulings for {name}?",
        "What are the official rulings for {name}?",
    ],
    "card_with_cmc": [
        "What is a card with converted mana cost (cmc) {value}?",
        "Can you name a card that has a converted mana cost of {value}?",
        "Give me a card with a cmc of {value}.",
    ],
    "side": [
        "What card side is {name} on?",
        "Can you tell me what side {name} is on?",
        "What side is {name} on?",
    ],
    "side_name": [
        "What is the name of side {value} of {name}?",
        "Can you tell me the name of side {value} of {name}?",
        "What is the name of {value} side of {name}?",
    ],
    "combo": [
        "How can you create a combo with {value}?",
    ],
}

# Answer sentences for the null branches.
NO_MANA_COST = "{name} has no mana cost"
LAND_NO_MANA_COST = "{name} is a land and land cards have no mana cost"
NO_POWER = "{name} has no power"
NO_TOUGHNESS = "{name} has no toughness"

# Combo answer fragments, in output order.
COMBO_FORMED = "This combo can be formed with "
COMBO_IDENTITY = "Color identity: "
COMBO_MANA = "Mana cost: "
COMBO_STEPS = "Steps:\n"
COMBO_RESULT = "Result:\n"
COMBO_PREREQ = "Other prerequisites:\n"
COMBO_ALL_ZONE = "  - All permanants must be "
ABBREVIATIONS = [("LTB", "leaves the battlefield"), ("ETB", "enters the battlefield")]

# Search-result rendering labels.
RESULT_SCORE = "Relevancy Score: "
RESULT_MANA = "Mana Cost: "
RESULT_CMC = "Coverted Mana Cost (cmc): "
RESULT_IDENTITY = "Color Identity: "
RESULT_RARITY = "Rarity: "
RESULT_LOYALTY = "Loyalty: "

# Document content labels.
DOC_LABELS = {
    "name": "Card Name: ", "mana_cost": "Mana Cost: ", "type": "Type: ",
    "text": "Card Text: ", "pt": "Power/Toughness: ", "power": "Power: ",
    "toughness": "Toughness: ", "loyalty": "Loyalty: ", "side": "Side: ",
}

DEFAULT_TOP_K = 10
DEFAULT_TEST_FRACTION = 0.2
