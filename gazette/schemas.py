"""Schemas of the article store and of what feeds it."""

from __future__ import annotations

ARTICLES = """id STRING, external_id STRING, title STRING, source_name STRING, source_id STRING, source_url STRING, article_url STRING,
published_at TIMESTAMP_NTZ, author_name STRING, hero_image_url STRING, raw_content STRING, cleaned_content STRING,
distilled_body_html STRING, distiller_version INT, content_source STRING, content_word_count INT,
is_content_likely_complete BOOLEAN, summary_short STRING, summary_bullets ARRAY<STRING>, ai_summary_short STRING,
ai_summary_bullets ARRAY<STRING>, category STRING, tags ARRAY<STRING>, language STRING, is_bookmarked BOOLEAN,
is_read BOOLEAN, cluster_id STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"""
INTERACTIONS = "id STRING, article_id STRING, action_type STRING, ts TIMESTAMP_NTZ, reading_duration DOUBLE, scroll_depth DOUBLE"
SOURCES = "id STRING, outlet_name STRING, region STRING, feed_url STRING, is_main BOOLEAN, language STRING, tags ARRAY<STRING>, note STRING"
FEED_ITEMS = """source_id STRING, pos INT, title STRING, link STRING, summary STRING, content STRING, published_at_raw STRING,
categories ARRAY<STRING>, language STRING, guid STRING, author STRING, image_url STRING"""
RAW_FEEDS = "source_id STRING, fetched_at TIMESTAMP_NTZ, payload STRING"
CHECKS = """source_id STRING, outlet STRING, region STRING, is_main BOOLEAN, feed_url STRING, status STRING, articles_count INT,
articles_with_image INT, articles_with_body INT, elapsed_ms INT, message STRING"""
PREFERENCES = """id STRING, preferred_categories ARRAY<STRING>, preferred_topics ARRAY<STRING>, hidden_sources ARRAY<STRING>,
favorite_sources ARRAY<STRING>, preferred_language STRING, enabled_regions ARRAY<STRING>, has_completed_onboarding BOOLEAN, updated_at TIMESTAMP_NTZ"""
