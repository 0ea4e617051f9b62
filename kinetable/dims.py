"""Dimension data: class lists, keyword rules, joint maps, skeleton edges.

Everything under "Fixed values" must equal the published values for results to
be right; it is stated as plain lists in natural order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- Fixed values: sensor and camera -------------------------------------------------
SENSOR_WIDTH, SENSOR_HEIGHT = 346, 260
COLOR_FRAME = (1920, 1080)
FOCAL = (1100.0, 1100.0)
PRINCIPAL_POINT = (960.0, 540.0)

# --- Fixed values: event-camera action classes (index = label, first six aggressive) --
EVENT_ACTIONS = [
    "slapping", "punching", "kicking", "strangling", "hair_grab", "pushing",
    "walking", "greeting", "handshake", "finger_guessing",
]
EVENT_AGGRESSIVE_COUNT = 6
# keyword -> class, tried in this order
EVENT_KEYWORDS = [
    ("slap", "slapping"), ("punch", "punching"), ("kick", "kicking"),
    ("strangle", "strangling"), ("strangling", "strangling"),
    ("hair", "hair_grab"), ("hairgrab", "hair_grab"), ("push", "pushing"),
    ("walk", "walking"), ("greet", "greeting"), ("shake", "handshake"),
    ("handshake", "handshake"), ("finger", "finger_guessing"), ("guess", "finger_guessing"),
]

# --- Fixed values: depth-camera action ids (position = label) --------------------------
DEPTH_AGGRESSIVE = [
    (50, "punch_slap"), (51, "kicking"), (52, "pushing"), (106, "hit_with_object"),
    (107, "wield_knife"), (108, "knock_over"), (109, "grab_stuff"), (111, "step_on_foot"),
]
DEPTH_SUBTLE = [(54, "point_finger"), (93, "shake_fist"), (116, "follow"), (117, "whisper")]
DEPTH_NEUTRAL = [
    (53, "pat_on_back"), (55, "hugging"), (58, "handshake"),
    (112, "high_five"), (118, "exchange_things"), (119, "support_somebody"),
]

# --- Fixed values: outdoor-interaction classes (keyword order = label) ------------------
INTERACTION_CLASSES = ["handshake", "hug", "kick", "point", "punch", "push"]
INTERACTION_AGGRESSIVE = ["kick", "punch", "push"]
INTERACTION_NEUTRAL = ["handshake", "hug", "point"]
INTERACTION_AGGRESSIVE_IDS = [2, 4, 5]
INTERACTION_NEUTRAL_IDS = [0, 1, 3]
INTERACTION_DATASET = "ut_interaction"

BINARY_NAMES = ["neutral", "aggressive"]
NEUTRAL, AGGRESSIVE = 0, 1

# --- Fixed values: skeletons -----------------------------------------------------------
NUM_JOINTS = 17
NUM_DEPTH_JOINTS = 25
# depth-camera joint feeding each of the 17 slots; slots 1-4 have no source joint
DEPTH_TO_POSE = [3, 3, 3, 3, 3, 4, 8, 5, 9, 6, 10, 12, 16, 13, 17, 14, 18]
FACE_SLOTS = [1, 2, 3, 4]
SKELETON_EDGES = [
    (15, 13), (13, 11), (16, 14), (14, 12), (11, 12), (5, 11), (6, 12), (5, 6), (5, 7),
    (6, 8), (7, 9), (8, 10), (1, 2), (0, 1), (0, 2), (1, 3), (2, 4), (3, 5), (4, 6),
]
# weight of the self, neighbour and extended-neighbour partitions
PARTITION_WEIGHTS = [1.0, 1.0, 0.5]

# --- Fixed values: media suffixes --------------------------------------------------------
VIDEO_SUFFIXES = ["mp4", "avi", "mov", "mkv"]
IMAGE_SUFFIXES = ["png", "jpg", "jpeg", "bmp"]


def depth_classes(spark: SparkSession) -> DataFrame:
    """Relevant depth-camera classes: action, label, label_name, tier, aggressive (18 rows)."""
    tiers = [
        ("aggressive", DEPTH_AGGRESSIVE), ("subtle", DEPTH_SUBTLE), ("neutral", DEPTH_NEUTRAL),
    ]
    named = [(action, name, tier) for tier, members in tiers for action, name in members]
    rows = [
        (action, label, name, tier, tier == "aggressive")
        for label, (action, name, tier) in enumerate(named)
    ]
    return spark.createDataFrame(
        rows, "action int, label int, label_name string, tier string, aggressive boolean"
    )


def depth_action_ids(classes: str) -> list[int] | None:
    """Action ids of a class filter: relevant, aggressive, or all (None)."""
    aggressive = [action for action, _ in DEPTH_AGGRESSIVE]
    others = [action for action, _ in DEPTH_SUBTLE + DEPTH_NEUTRAL]
    return {"relevant": aggressive + others, "aggressive": aggressive, "all": None}[classes]


def event_classes(spark: SparkSession) -> DataFrame:
    """Event-camera classes: label, label_name, aggressive (10 rows)."""
    rows = [(i, name, i < EVENT_AGGRESSIVE_COUNT) for i, name in enumerate(EVENT_ACTIONS)]
    return spark.createDataFrame(rows, "label int, label_name string, aggressive boolean")


def interaction_classes(spark: SparkSession) -> DataFrame:
    """Outdoor-interaction classes: label, label_name, aggressive (6 rows)."""
    rows = [(i, n, n in INTERACTION_AGGRESSIVE) for i, n in enumerate(INTERACTION_CLASSES)]
    return spark.createDataFrame(rows, "label int, label_name string, aggressive boolean")


def skeleton_edges(strategy: str = "spatial") -> list[tuple[int, int, int, float]]:
    """(partition, src, dst, weight) over the symmetric skeleton graph.

    ``spatial`` has three partitions: self loops, neighbours, half-weighted neighbours.
    Any other strategy has one partition holding self loops and neighbours.
    """
    loops = [(j, j) for j in range(NUM_JOINTS)]
    links = sorted({pair for a, b in SKELETON_EDGES for pair in ((a, b), (b, a))})
    groups = [loops, links, links] if strategy == "spatial" else [loops + links]
    return [
        (k, src, dst, PARTITION_WEIGHTS[k]) for k, group in enumerate(groups) for src, dst in group
    ]


def skeleton_edge_table(spark: SparkSession, strategy: str = "spatial") -> DataFrame:
    return spark.createDataFrame(
        skeleton_edges(strategy), "partition int, src int, dst int, weight double"
    )
