"""Fixed values.

Everything in the first block must stay exactly as written: the
tokeniser, the mask token, the vocabulary specials, the placeholder
tokens and the sentence-weight constant define what a "word" and a
"masked text" are, so results only agree when these agree.
The second block holds the fixture rules of FIXTURES.md (gold spans,
raw-token matcher, sentence rule) shared with the SQL oracle.
"""

# --- fixed values -----------------------------------------------------------
# Each of these characters becomes its own token:  , . ; : ' ? ! " ( ) [ ]
PUNCT_CHARS = ",.;:'?!\"()[]"
PUNCT_CLASS = r"""[,.;:'?!"()\[\]]"""
ANON_TOKEN = "<ANON>"
EOS_TOKEN = "<EOS>"
UNK_TOKEN = "<UNK>"
SOS_TOKEN = "<SOS>"
# placeholder tokens found in inline-tag corpora, in this order
PLACEHOLDER_TOKENS = ["&YEAR", "&EMAIL", "&DATE", "&TIME"]
# smoothing constant of the frequency-weighted sentence vector
SIF_A = 1e-12
# the inline-tag markup and the document-end marker
ANON_OPEN = "<ANON>"
ANON_CLOSE = "</ANON>"
DOC_END_MARK = "~"
DOCSTART = "-DOCSTART-"
# number of request payloads a batch builder emits
N_REQUEST_BATCHES = 10

# --- fixture rules (FIXTURES.md §C) -------------------------------------------
# what counts as a space beside \s of the regex engines, and the separator below
ODD_SPACES = "[\x01\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# sentence end: one of . ! ? followed by whitespace
SENT_END = r"([.!?])\s+"
SENT_SEP = "\u0001"
# one raw token: a punctuation character, or a run of anything else but spaces
TOKEN = r"""[,.;:'?!"()\[\]]|[^\s,.;:'?!"()\[\]]+"""
# gold personal data: e-mail, IPv4, hex secret >= 16, any digit run (in this order)
GOLD = (r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
        r"|\d{1,3}(?:\.\d{1,3}){3}"
        r"|[0-9a-f]{16,}"
        r"|\d+")
# a sentence can match GOLD only if it holds a digit, an '@' or 16 hex letters
# in a row: a cheap exact pre-test before the full alternation
GOLD_PRETEST = r"[0-9@]|[a-f]{16}"
# rule set of the span baseline (stands in for a named-entity tagger):
# capitalised words and digit runs
BASELINE_SPANS = r"[A-Z][a-z]+|\d+"
