"""Column functions: URLs, HTML, e-mail, phones, social profiles, text."""
