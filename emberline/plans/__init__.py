"""From rule text to typed rules, and choices made about them."""
