"""Word sets, suffixes, weights and preference tables."""

# Question words and auxiliaries that never name a topic.
STOPWORDS = """a about above after am an and are as at became become been before being below but by can cause caused causes
could define describe did do does doing done during explain for from get got had has have having how if in into is it its
made make may me might must of on or shall should take tell that the then these this those through to took was were what
when where which who whom whose why will with would you""".split()

# Vague words that are no search terms.
SKIP_WORDS = """another anybody anyone anything awesome awful bad best better everybody everyone everything excellent good
great kind kinds many more most much nobody nothing other others people person persons poor quality some somebody someone
something stuff terrible that them these thing things this those type types value worst worth""".split()

BLACKLIST = sorted({*STOPWORDS, *SKIP_WORDS})

# Title suffixes of media articles, in the order in which they are tried.
MEDIA_SUFFIXES = [" (TV series)", " (film)", " (TV show)", " (television)"]

# Weights of a question's complexity, each for any of its substrings.
COMPLEXITY = [
    (2, [" and "]),
    (3, [" vs ", " versus "]),
    (3, ["compare", "difference", "versus", "vs"]),
    (2, ["relationship", "connect", "relate", "impact", "affect", "influence", "cause"]),
    (2, ["how does", "how do", "why", "explain"]),
    (2, ["history", "evolution", "development", "origin"]),
    (1, ["overview", "summary", "introduction", "basics"]),
    (2, ["future", "prediction", "will", "going to"]),
]
LONG_QUESTION_WORDS = 12

# Paragraphs read from each article, by the number of articles selected.
DEPTHS = {3: 20, 4: 15, 5: 12, 6: 10, 7: 8}
DEFAULT_DEPTH = 15

# Budgets in characters and rows.
ABSTRACT_LEAST, ABSTRACT_LENGTH, PREVIEW_LENGTH = 100, 500, 200
PARAGRAPH_LEAST, CONTENT_LENGTH = 50, 8000
SHORTLIST, SHORTLIST_EMPTY, ABSTRACTS, SOFT_CAP = 30, 15, 30, 100

# Models preferred for choosing articles, then for writing answers.
SELECTION_MODELS = """qwen2.5:32b-instruct qwen2.5:32b qwen2.5:14b-instruct qwen2.5:14b qwen2.5:7b-instruct mistral-small:latest
mistral-small mistral:7b hermes3:8b hermes3:latest llama3.2:3b llama3.1:8b phi3:medium""".split()
SYNTHESIS_MODELS = """llama3.1:8b-instruct llama3.1:8b gemma2:27b gemma2:9b mistral:7b granite3.1-dense:8b qwen2.5:7b llama3.3:70b
llama3.1:70b-instruct llama3.1:70b""".split()
#: Options of the two chat calls.
SELECTION_OPTIONS = {"num_predict": 200, "temperature": 0.2, "top_p": 0.9}
SYNTHESIS_OPTIONS = {"num_predict": 1500, "temperature": 0.7, "top_p": 0.9, "repeat_penalty": 1.1}
