"""Words that queries and detections are described with."""

from __future__ import annotations

# The labels, sizes and colours of the data model, and the words that queries use for them.
SUPPORTED_LABELS = ("person", "car", "truck", "bus", "dog", "cat", "bird", "bicycle", "motorcycle")
SIZES = ("tiny", "small", "medium", "large", "huge")
COLORS = ("red", "orange", "yellow", "green", "cyan", "blue", "purple", "black", "white", "gray", "unknown")

COLOR_WORDS = {
    "red": "red", "orange": "orange", "brown": "orange", "amber": "orange", "yellow": "yellow", "green": "green",
    "lime": "green", "teal": "green", "cyan": "cyan", "blue": "blue", "navy": "blue", "purple": "purple",
    "violet": "purple", "magenta": "purple", "pink": "purple", "black": "black", "white": "white", "silver": "gray",
    "gray": "gray", "grey": "gray",
}
LABEL_WORDS = {label: label for label in SUPPORTED_LABELS} | {
    "people": "person", "pedestrian": "person", "pedestrians": "person", "cars": "car", "automobile": "car",
    "automobiles": "car", "vehicle": "car", "trucks": "truck", "lorry": "truck", "lorries": "truck", "semi": "truck",
    "buses": "bus", "coach": "bus", "motorcycles": "motorcycle", "bikes": "motorcycle", "bicycles": "bicycle",
    "cyclist": "bicycle", "cyclists": "bicycle", "dogs": "dog", "cats": "cat", "birds": "bird",
}
SIZE_WORDS = {
    "tiny": "tiny", "small": "small", "smallish": "small", "medium": "medium", "mid": "medium", "average": "medium",
    "big": "large", "large": "large", "bigger": "large", "huge": "huge", "xl": "huge", "enormous": "huge",
}
SIZE_STEPS = ((0.40, "huge"), (0.20, "large"), (0.08, "medium"), (0.02, "small"))
UNAVAILABLE = "Description unavailable"
