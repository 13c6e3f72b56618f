"""What happens between the text of a query and its plan."""
