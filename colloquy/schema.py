"""Fixed values and types of the transcript model."""

from __future__ import annotations

# Token types of the transcript model.
REGULAR, RETRACE, FEAT, FP, ANNOT, PUNCT, CORRECTION = range(7)

# Punctuation that ends an utterance, punctuation inside one, words without content, group marks.
ENDING_PUNCT = [".", "?", "!", "+//.", "+/.", "+...", '+"/.', "+..?", '+".', "+//?", "+.", "+!?", "+/?", "...", "(.)"]
MOR_PUNCT = ["‡", "„", ","]
NO_CONTENT = ["xxx", "yyy", "www"]
REPEAT_MARKS = ["[/]", "[//]", "[///]", "[////]", "[/////]", "[/-]"]
NORMAL_MARKS = ["[?]", "[!!]", "[!]", "[>]", "[<]"]

# English filled pauses and replacements as (original, main line, lemma).
FILLED_PAUSES = [("um", "&-um", "um"), ("ur", "&-ur", "ur"), ("uh", "&-uh", "uh")]
REPLACEMENTS = [("mm-hmm", "mhm", "mhm"), ("mm-hum", "mhm", "mhm"), ("'em", "(th)em", "them"), ("cuz", "(be)cause", "because"), ("'cause", "(be)cause", "because")]

LINE = "doc_id bigint, line_no bigint, tier string, text string"
FORM = "doc_id bigint, line_no bigint, tier string, form_no bigint, text string, type int"
