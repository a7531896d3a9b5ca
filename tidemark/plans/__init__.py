"""Query objects, the planner and the text command front end."""
