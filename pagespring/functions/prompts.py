"""The captioner's prompts."""

CONTEXT_CHARS = 300

# The prompts' wording and layout decide a captioner's answers.
BARE = """\n\nQuestion: You are assisting in transcribing analytical evidence from historical documents.
            This image was found embedded in an official document.
            Provide a detailed forensic description of the image.
            Describe all visible people, objects, locations.
            \n\nAnswer:"""
TOLD = """\n\nQuestion: You are assisting in transcribing analytical evidence from historical documents.
            This image was found embedded in an official document. 
            The surrounding text in the document reads: \"{context}\".
            Based on this context, provide a detailed forensic description of the image.
            Describe all visible people, objects, locations.
            \n\nAnswer:"""
BEFORE, AFTER = TOLD.split("{context}")


def prompt(context: str) -> str:
    """For text of which nothing is left when trimmed, the bare prompt."""
    return BEFORE + context[:CONTEXT_CHARS] + AFTER if context.strip() else BARE
