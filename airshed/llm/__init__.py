"""Training-data operators (deduplication, filtering, tokenising, scoring, extraction).

Nothing outside this subpackage imports it; ``airshed.llm.queries`` holds the
registered ``opN_*`` queries and their SQL.
"""
