"""Names, labels and bounds that results depend on."""

# The display attribute(s) of each item catalogue.
DATASET_ATTRIBUTES = {
    "mind": ["title"],
    "pens": ["title", "cat"],
    "goodreads": ["title"],
    "books": ["title"],
    "movielens": ["title"],
    "microlens": ["title"],
    "netflix": ["title", "year"],
    "cds": ["title"],
    "lastfm": ["track_name", "artist_name"],
    "hm": ["detail_desc"],
    "pog": ["title_en"],
    "electronics": ["title"],
    "steam": ["title"],
    "hotelrec": ["hotel_name", "hotel_location"],
    "yelp": ["name", "city"],
}

# Fixed values: (topic, item type) of each item catalogue.
DATASET_TOPICS = {
    "mind": ("news articles", "News Article"),
    "pens": ("news articles", "News Article"),
    "goodreads": ("books", "Book"),
    "books": ("books", "Book"),
    "movielens": ("movies", "Movie"),
    "microlens": ("movies", "Movie"),
    "netflix": ("movies", "Movie"),
    "cds": ("music albums", "Music Album"),
    "lastfm": ("music tracks", "Music Track"),
    "hm": ("fashion items", "Fashion Item"),
    "pog": ("fashion products", "Fashion Product"),
    "electronics": ("electronics products", "Electronics Product"),
    "steam": ("video games", "Video Game"),
    "hotelrec": ("hotels", "Hotel"),
    "yelp": ("restaurants", "Restaurant"),
}
DEFAULT_TOPIC = "items"
DEFAULT_ITEM_TYPE = "Item"
DEFAULT_ATTRIBUTES = ["title"]


def topic_of(dataset: str) -> tuple[str, str]:
    """Topic and item type of an item catalogue, those for any catalogue where it is not known."""
    return DATASET_TOPICS.get(dataset, (DEFAULT_TOPIC, DEFAULT_ITEM_TYPE))


# Display labels of item attributes.
ATTRIBUTE_LABELS = {
    "title": "Title",
    "cat": "Category",
    "track_name": "Track",
    "artist_name": "Artist",
    "hotel_name": "Hotel",
    "hotel_location": "Location",
    "name": "Name",
    "city": "City",
    "year": "Year",
}

# Default (minimum, maximum) history length of each catalogue.
HISTORY_BOUNDS = {
    "books": (1, 52),
    "lastfm": (100, 100),
    "microlens": (3, 15),
    "netflix": (1, 100),
    "pens": (1, 274),
}

# The five graded dimensions of each question intent.
RUBRIC_DIMENSIONS = {
    "Leisure": ["User Satisfaction", "Engagement", "Appropriateness", "Creativity", "Factuality"],
    "Factual_QA": ["Factuality", "User Satisfaction", "Clarity", "Completeness", "Logical Coherence"],
    "Seek_Creativity": ["User Satisfaction", "Logical Coherence", "Creativity", "Richness", "Factuality"],
    "Ask_for_Advice": ["User Satisfaction", "Factuality", "Fairness and Responsibility", "Creativity", "Richness"],
    "Solve_Professional_Problem": ["Factuality", "User Satisfaction", "Clarity", "Logical Coherence", "Completeness"],
    "API": ["Factuality", "User Satisfaction", "Clarity", "Logical Coherence", "Completeness"],
    "Text_Assistant": ["Clarity", "User Satisfaction", "Logical Coherence", "Factuality", "Creativity"],
}
OVERALL_SCORE_KEYS = ["综合得分", "Overall"]
SCORED_INTENTS = ["Leisure", "Ask_for_Advice", "Seek_Creativity"]

# Keys that may hold the scoreable text of a reply, first match wins.
ANSWER_KEYS = [
    "summarised_final_answer", "summary", "answer", "response",
    "final_answer", "output", "content", "text",
]

# Markers in replies and prompts.
FINAL_MARKER = "assistantfinal"
ANALYSIS_MARKER = "assistantanalysis"
THINK_END = "</think>"
PASS_THROUGH_PROMPT = "[DIRECT_PASS_THROUGH_SINGLE_ANSWER]"
EMPTY_REPLY = "[ERROR: Empty response after inference]"
RECOVERABLE_REPLY = "[ERROR: Generation skipped due to recoverable vLLM error]"
RETRIES_EXHAUSTED_REPLY = "[ERROR: Max retries exceeded]"
RECOVERABLE_ERRORS = ["Invalid prefix", "exceed the max model length"]
