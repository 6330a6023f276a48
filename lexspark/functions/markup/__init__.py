"""Wiki markup: a parser, a template expander with a registry of module functions, and plain text."""
