"""Catalogue building on Spark: landed sitemaps, feeds, API posts and pages in;
deduplicated, validated, change-tracked catalogue tables out."""
