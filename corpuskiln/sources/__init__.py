"""Tables of prompts, files and papers."""
