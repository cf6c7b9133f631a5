"""Pure ``Column`` expressions; no Python runs per row."""

from lexiforge.functions.codes import (  # noqa: F401
    card_type_get, card_type_value, color_code, color_get, color_identity_code,
    color_identity_get, color_list_delimited, float_text_to_int, identity_name,
    is_fractional_text, normalize_color_code, sort_colors, strip_brackets, strip_commas,
)
from lexiforge.functions.predicates import (  # noqa: F401
    code_match, compile_filters, contains_ci, contains_cs, contains_regex, contains_word,
    not_empty_keep_null, not_empty_sql,
)
from lexiforge.functions.text import (  # noqa: F401
    expand_abbreviations, face_name, md5_bucket, ordinal_lines, split_lines,
    train_tokens, word_tokens,
)
