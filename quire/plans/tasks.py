"""Task specifications for the instruction builders.

Template wording and answer wording are inputs of the builders; these are
our own English templates, written for the test-table stand-ins (orders,
user events, catalogue parts, conversations).  Each template's literal text
is distinct so recognition (FLT5) finds exactly one template per rendered
prompt.  The probabilities in ``probs`` and ``p_suffix`` are fixed values
"""

from __future__ import annotations

from dataclasses import dataclass, field

SEED = 1130          # build-side seed
ANSWER_SUFFIX = "\nAnswer:"


@dataclass(frozen=True)
class TaskSpec:
    name: str
    task_type: str
    templates: tuple[str, ...]
    p_suffix: float = 0.6
    probs: dict = field(default_factory=dict)
    words: dict = field(default_factory=dict)


RELATIONS = TaskSpec(
    "relations", "spo_generation",
    (
        "Order book extract\n==\n{text}\n==\nSort its orders under these priority classes, with each order's status: {choices}",
        "Priority classes to report on: {choices}\nBelow is one customer-year of the order book. Report order and status per class.\n{text}",
        "A clerk asks about the classes {choices}.\nAnswer from this ledger line, one class a row > {text}",
        "{text}\n(For every class in [{choices}] write down the orders it covers and their status codes.)",
    ),
    p_suffix=0.605,
    probs={"exist": 0.75, "add_absent": 0.47},
    words={"none": "The ledger line has nothing under these classes.",
           "line_a": "Class ", "line_b": " covers",
           "head": "entry ", "tail": "state "},
)

ENTITIES = TaskSpec(
    "entities", "ner",
    (
        "Activity log of one user and day\n>> {text}\nGroup the logged values by activity. Activities wanted: {choices}",
        "Wanted activities = {choices}\nRead the log and write one row per activity with its values.\nLog = {text}",
        "From the log between the bars, collect what belongs to {choices}.\n||{text}||",
        "{text}\n^ That was a day's log. Which values go with each of: {choices} ^",
        "Fill this table, first column fixed to {choices}, second column from the log that follows.\n{text}",
    ),
    probs={"exist": 0.93, "add_absent": 0.42},
    words={"head": "Values by activity:\n", "line": " values",
           "none": "None of the wanted activities was logged."},
)

TAGGED = TaskSpec(
    "tagged_entities", "ner",
    (
        "Tagged sequence:\n{text}\nFind the entities of types: {choices}",
        "From the tagged sequence below, list the {choices} entities.\n{text}",
        "Sequence: {text}\nWhich entities of the types {choices} does it contain?",
        "Recognise entities in the sequence.\nSequence: {text}\nTypes to report: {choices}",
        "Report the sequence entities of kinds {choices}:\n{text}",
        "Label sequence entities.\n{text}\nKinds: {choices}",
    ),
    probs={"exist": 0.88, "add_absent": 0.5},
    words={"head": "Values by activity:\n", "line": " values",
           "none": "None of the wanted activities was logged."},
)

EVENTS = TaskSpec(
    "events", "event_extraction",
    (
        "Extract the order events from the account record:\n{text}",
        "{text}\nList every order event: which order, its state, kinds and items.",
        "Account record: {text}\nWhat order events does it contain?",
        "Find the order events.\nRecord: {text}",
        "Order event extraction:\n{text}",
        "Give order, state, kinds and items of each event in:\n{text}",
        "Record under review: {text}\nDescribe its order events.",
    ),
    words={"head": "The order events are:\n", "keys": ("Order", "State", "Kinds", "Items"),
           "list_keys": ("Kinds", "Items")},
)

NORMALIZATION = TaskSpec(
    "normalization", "normalization",
    (
        "Catalogue entry: {text}\nWhich standard part names fit it?\nOptions: {choices}",
        "Map the catalogue entry to standard part names.\n{text}\nCandidates: {choices}",
        "Normalise this entry: {text}\nStandard names: {choices}",
        "{text}\nPick the standard names among: {choices}",
        "Standard part naming.\nEntry: {text}\nName list: {choices}",
        "Choose the canonical names for the entry below from {choices}.\n{text}",
        "Which of {choices} name the parts of this entry?\n{text}",
    ),
    probs={"exist": 0.85},
    words={"none": "No listed name fits the entry."},
)

CLASSIFICATION = TaskSpec(
    "classification", "cls",
    (
        "Which source is this text from?\nText: {text}\nSources: {choices}",
        "Classify the origin of the text.\n{text}\nOrigin options: {choices}",
        "Text: {text}\nPick its source from: {choices}",
        "Decide the source label of the passage below, choosing among {choices}.\n{text}",
        "Source identification.\nPassage: {text}\nCandidate sources: {choices}",
    ),
    probs={"not_exist": 0.1},
    words={"none": "None of the listed types.", "drop": "src0"},
)

CLASSIFICATION_SIZED = TaskSpec(
    "classification_sized", "cls",
    (
        "Which region label fits this text?\nText: {text}\nLabels: {choices}",
        "Assign a region label to the passage.\n{text}\nRegion options: {choices}",
        "Passage: {text}\nChoose its region from: {choices}",
        "Region classification among {choices} for:\n{text}",
        "Label the passage with one region.\nPassage: {text}\nRegions: {choices}",
    ),
    probs={"exist": 0.96},
    words={"none": "None of the listed types."},
)

PAIR_MATCH = TaskSpec(
    "pair_match", "cls",
    (
        "Are these two passages in the same language?\nFirst: {a}\nSecond: {b}\nOptions: same, different\nAnswer:",
        "Passage one: {a}\nPassage two: {b}\nDo they share a language?\nOptions: same, different\nAnswer:",
        "Compare the languages of the two texts.\n{a}\n---\n{b}\nOptions: same, different\nAnswer:",
        "Is the second text written in the language of the first?\nText A: {a}\nText B: {b}\nOptions: yes, no\nAnswer:",
        "Text A: {a}\nText B: {b}\nSame language for both texts?\nOptions: yes, no\nAnswer:",
        "Judge whether both passages use one language.\nLeft: {a}\nRight: {b}\nOptions: yes, no\nAnswer:",
    ),
    p_suffix=0.0,
    # One pair of answers for each template, in its order.
    words={"wording": (("same", "different"),) * 3 + (("yes", "no"),) * 3},
)

ORDINAL = TaskSpec(
    "ordinal_match", "matching",
    (
        "Dispatch desk: {a}, placed by {b}. Put it in one of the lanes [{choices}].",
        "Lanes from fast to slow: {choices}\nWhere does {a} of {b} go?",
        "{b} is waiting for {a}.\nWrite the lane ({choices}) it was booked on.",
        "Booking check / {a} / {b} / lanes on offer: {choices} /",
        "Someone from {b} rings about {a}; name its lane out of {choices}, nothing else.",
    ),
    words={"choices": ("express", "fast", "normal", "unassigned", "slow")},
)

RELEVANCE = TaskSpec(
    "relevance", "ir",
    (
        "One line of a chat and a candidate next line.\nLine: {a}\nNext: {b}\nVerdict (follows / does not follow):",
        "Would an assistant that was told <{a}> come back with <{b}>? Say follows or does not follow.",
        "Candidate: {b}\nIt should continue this user turn: {a}\nfollows or does not follow?",
        "follows / does not follow\n1. {a}\n2. {b}\nChoose whether 2 continues 1.",
    ),
    probs={"relevant": 0.34},
    words={"yes": "follows", "no": "does not follow"},
)

DIALOGUE = TaskSpec(
    "dialogue", "response_generation",
    (
        "Continue the conversation as the assistant.\n{text}",
        "{text}\nWrite the assistant's next reply.",
        "Conversation so far:\n{text}\nWhat should the assistant say next?",
        "Reply to the user given this history.\n{text}",
        "Dialogue:\n{text}\nAssistant reply:",
    ),
    words={"user": "\n\nUser: ", "assistant": "\n\nAssistant: "},
)

ALL_TASKS = (RELATIONS, ENTITIES, TAGGED, EVENTS, NORMALIZATION, CLASSIFICATION,
             CLASSIFICATION_SIZED, PAIR_MATCH, ORDINAL, RELEVANCE, DIALOGUE)
