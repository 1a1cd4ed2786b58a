"""All registered queries: importing the modules registers them."""

from textloom.plans import book, boxes, camera, export, instances, layout, rules, search, sources, stored, text, view, widths
from textloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "book", "boxes", "camera", "export", "instances", "layout", "rules", "search", "sources", "stored", "text", "view", "widths"]
